"""Invariants over the derived tables."""
from pyspark.sql import functions as F

from orderlens.operators import metrics, orders, split
from orderlens.plans import rules
from orderlens.sources.derived import derived_catalog
from tests.conftest import SF_SMALL


def test_base_has_one_row_per_kept_order(spark):
    c = derived_catalog(spark, SF_SMALL)
    base = orders.base_orders(c)
    kept = orders.drop_canceled(c["orders"])
    assert base.count() == kept.count() == base.select("order_id").distinct().count()


def test_item_price_is_conserved(spark):
    c = derived_catalog(spark, SF_SMALL)
    base = orders.base_orders(c)
    kept = orders.drop_canceled(c["orders"]).select("order_id")
    items = c["order_items"].join(kept, "order_id")
    a = base.agg(F.sum("total_items_price")).first()[0]
    b = items.agg(F.sum("price")).first()[0]
    assert abs(a - b) < 1e-6 * abs(b)


def test_split_disjoint_and_complete(spark):
    md = orders.model_dataset(derived_catalog(spark, SF_SMALL))
    tr, te = split.train_test_split(md)
    n, a, b = md.count(), tr.count(), te.count()
    assert a + b == n and tr.join(te, "order_id").count() == 0
    assert 0.1 < b / n < 0.3


def test_folds_partition_train(spark):
    md = orders.model_dataset(derived_catalog(spark, SF_SMALL))
    f = split.with_folds(md, 3)
    counts = {r.fold: r["count"] for r in f.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == md.count()


def test_confusion_sums_to_n(spark):
    md = orders.model_dataset(derived_catalog(spark, SF_SMALL))
    r = rules.rule_classifications(md, ["late"])
    cm = metrics.confusion_matrix(r)
    assert cm.agg(F.sum("n")).first()[0] == r.count()
    assert cm.count() == 4


def test_result_independent_of_shuffle_partitions(spark):
    from orderlens.operators import drivers
    c = derived_catalog(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        outs = []
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = drivers.category_review_stats(c["order_reviews"], c["order_items"], c["products"])
            outs.append(sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in df.collect()))
            split_ids = sorted(r.order_id for r in split.with_split(c["orders"]).filter("is_test").collect())
            outs.append(split_ids)
        assert outs[0] == outs[2] and outs[1] == outs[3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_prefers_aggregation_over_fanout(spark):
    """The category statistics equal the literal review × item fan-out."""
    from orderlens.operators import drivers
    c = derived_catalog(spark, SF_SMALL)
    fast = {r.product_category_name: (r.n_reviews, round(r.pct_bad, 9))
            for r in drivers.category_review_stats(c["order_reviews"], c["order_items"], c["products"]).collect()}
    r = c["order_reviews"].filter("review_score IS NOT NULL")
    fan = (r.join(c["order_items"].select("order_id", "product_id"), "order_id", "left")
           .join(c["products"], "product_id", "left").filter("product_category_name IS NOT NULL")
           .groupBy("product_category_name")
           .agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("review_score") <= 2, 1.0).otherwise(0.0)) * 100).alias("p")))
    slow = {x.product_category_name: (x.n, round(x.p, 9)) for x in fan.collect()}
    assert fast == slow
