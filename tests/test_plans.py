"""Physical-plan assertions: the plan shapes the design relies on."""
import pytest

from orderlens.plans.queries import REGISTRY
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["model_dataset", "worst_categories", "worst_states", "delay_by_score",
                                  "cluster_features", "residual_bins", "box_stats"])
def test_no_cartesian_no_python(spark, name):
    p = plan(REGISTRY[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def _read_schemas(df):
    import re
    return set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().executedPlan().toString()))


def test_only_needed_columns_are_read(spark):
    # category statistics need only the order and part keys of lineitem: the
    # item-numbering window and every other column are pruned away
    s = _read_schemas(REGISTRY["worst_categories"](spark, SF_SMALL))
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in s
    assert "struct<p_partkey:bigint,p_brand:string>" in s
    assert not any("l_extendedprice" in x or "l_tax" in x for x in s)
    assert _read_schemas(REGISTRY["orders_per_month"](spark, SF_SMALL)) == \
        {"struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>"}


def test_filters_reach_scan(spark):
    p = REGISTRY["orders_per_month"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in p


def test_joins_reuse_order_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from orderlens.operators import orders
        from orderlens.sources.derived import derived_catalog
        c = derived_catalog(spark, SF_SMALL)
        df = orders.base_orders(c)
        p = df._jdf.queryExecution().executedPlan().toString()
        # one exchange per aggregate input + orders on the order key; no exchange between the three joins
        assert p.count("SortMergeJoin") >= 3
        n_order_exchanges = p.count("hashpartitioning(order_id")
        assert n_order_exchanges <= 5, n_order_exchanges
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
