"""A third of all item rows on one order: results stay whole and exact.

The fixture re-keys every third lineitem of the driver data onto one order
(so that order holds ~1/3 of all lines), then the per-order consolidation
and the category statistics are compared with DuckDB brute force over the
same rows (the literal fan-out).
"""
import duckdb
import pytest
from pyspark.sql import functions as F

from orderlens.operators import drivers, orders
from orderlens.sources.derived import derived_catalog
from tests.conftest import SF_SMALL

HOT = 1


@pytest.fixture(scope="module")
def skewed(spark):
    c = derived_catalog(spark, SF_SMALL)
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li = li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(HOT)).otherwise(F.col("l_orderkey")))
    from orderlens.sources.derived import derived_order_items
    c2 = dict(c.items())
    c2["order_items"] = derived_order_items(li)
    return c2, li


def test_hot_order_holds_a_third(spark, skewed):
    c, li = skewed
    n, hot = li.count(), li.filter(F.col("l_orderkey") == HOT).count()
    assert hot > n / 4


def test_item_numbering_exact_under_skew(spark, skewed):
    from orderlens.operators import reshape
    c, li = skewed
    base = li.select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey", "l_suppkey",
                     "l_extendedprice", "l_quantity", "l_shipdate")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    got = reshape.rank_within_key(base, "order_id", order, "r", hot_threshold=200, chunk_rows=150)
    con = duckdb.connect()
    want = con.execute(f"""SELECT l_orderkey, {', '.join(order)}, row_number() OVER (PARTITION BY l_orderkey ORDER BY
        {', '.join(order)}) AS r FROM read_parquet('{SF_SMALL}/lineitem.parquet') """.replace(
        "FROM read_parquet", "FROM (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey) "
        "FROM read_parquet").replace("lineitem.parquet') ", "lineitem.parquet'))")).fetchall()
    g = sorted(tuple(r) for r in got.select("order_id", *order, "r").collect())
    assert g == sorted(want)


def test_consolidation_whole_under_skew(spark, skewed):
    c, li = skewed
    base = orders.base_orders(c)
    row = base.filter(F.col("order_id") == HOT).first()
    hot_items = li.filter(F.col("l_orderkey") == HOT)
    assert row is None or row.n_items == hot_items.count()
    total = base.agg(F.sum("n_items")).first()[0]
    kept = orders.drop_canceled(c["orders"]).select("order_id")
    assert total == c["order_items"].join(kept, "order_id").count()


def test_category_stats_equal_fanout_under_skew(spark, skewed):
    c, li = skewed
    fast = {r.product_category_name: (r.n_reviews, round(r.mean_score, 9), round(r.pct_bad, 9))
            for r in drivers.category_review_stats(c["order_reviews"], c["order_items"], c["products"]).collect()}
    r = c["order_reviews"].filter("review_score IS NOT NULL")
    fan = (r.join(c["order_items"].select("order_id", "product_id"), "order_id", "left")
           .join(c["products"], "product_id", "left").filter("product_category_name IS NOT NULL")
           .groupBy("product_category_name")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("review_score").alias("m"),
                (F.avg(F.when(F.col("review_score") <= 2, 1.0).otherwise(0.0)) * 100).alias("p")))
    slow = {x.product_category_name: (x.n, round(x.m, 9), round(x.p, 9)) for x in fan.collect()}
    assert fast == slow


def test_orders_without_items_are_dealt_to_many_tasks(spark):
    """No product is no key of its own: a table mostly of item-less orders still spreads over the join's partitions."""
    data = {
        "orders": spark.range(4000).selectExpr("cast(id as string) order_id", "cast(id % 7 as string) customer_id",
                                               "'delivered' order_status"),
        "order_items": spark.range(40).selectExpr("cast(id as string) order_id", "1 order_item_id", "cast(id % 3 as string) product_id",
                                                  "'s' seller_id", "1.0D price", "0.5D freight_value"),
        "order_reviews": spark.range(4000).selectExpr("cast(id as string) order_id", "cast(id as string) review_id", "5 review_score"),
        "payments": spark.range(4000).selectExpr("cast(id as string) order_id", "1 payment_sequential", "'card' payment_type",
                                                 "1 payment_installments", "2.0D payment_value"),
        "customers": spark.range(7).selectExpr("cast(id as string) customer_id", "'SP' customer_state"),
        "products": spark.range(3).selectExpr("cast(id as string) product_id", "concat('c', id) product_category_name"),
    }
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = orders.base_orders(data).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000
    assert {r.order_id: r.product_category_name for r in rows if r.product_category_name} == {
        str(i): f"c{i % 3}" for i in range(40)}
    sizes = {}
    for r in rows:
        sizes[r._task] = sizes.get(r._task, 0) + 1
    assert len(sizes) == 8 and max(sizes.values()) < 1000
