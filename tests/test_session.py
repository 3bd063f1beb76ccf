"""Session helpers and the lazily built derived catalogue."""
from orderlens import session
from orderlens.sources.derived import LazyCatalog, derived_catalog
from tests.conftest import SF_SMALL


def test_checkpoint_dir_reads_session(spark):
    d = session.checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:  # a configured shared folder is used as is
        assert d == conf


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    m = session.materialize(df.filter("id % 2 = 0"))
    assert m.count() == 50
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # reads the checkpoint, not the original lineage


def test_scale_settings_sizes_partitions():
    small = session.scale_settings(10 << 30, 16)
    big = session.scale_settings(100 * 10 ** 12, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 40
    assert int(big["spark.sql.shuffle.partitions"]) * (256 << 20) >= 100 * 10 ** 12


def test_lazy_catalog_builds_on_access(spark):
    built = []
    cat = LazyCatalog({"a": lambda: built.append("a") or spark.range(1), "b": lambda: built.append("b") or spark.range(2)})
    assert "a" in cat and built == []
    assert cat["b"].count() == 2 and built == ["b"]
    assert [k for k, _ in cat.items()] == ["a", "b"] and built == ["b", "a"]
    c = derived_catalog(spark, SF_SMALL)
    assert set(c) >= {"orders", "order_items", "product_translation"}
