"""Order-shaped catalogue derived from the driver's star schema.

The driver tables (orders, lineitem, customer, part, supplier, nation,
region) carry no reviews, payments or categories, no NULLs and midnight
dates only. This module derives the marketplace shapes from them with
deterministic rules so the semantics that matter (NULL statuses, sub-day
times, undelivered orders, orders without reviews / items / payments,
second reviews, untranslated categories, lateness-dependent scores) are
exercised. Every table is a lazy projection of a whole driver table, so its
size grows with the data. The rules are fixed values shared with the SQL
oracle (``checks/oracle.py``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def derived_orders(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    status = (F.when(k % 101 == 0, F.lit(None).cast("string"))
              .when((F.col("o_orderstatus") == "P") & (k % 3 == 0), "canceled")
              .when(F.col("o_orderstatus") == "O", "shipped")
              .otherwise("delivered"))
    delivered = F.when(k % 29 == 0, F.lit(None)).otherwise(
        d + _hours(((k * 37) % 45 + 1) * 24 + k % 23))
    return o.select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"), status.alias("order_status"),
        (d + _hours(k % 24)).alias("order_purchase_timestamp"),
        (d + _hours(k % 24 + 1 + k % 30)).alias("order_approved_at"),
        delivered.alias("order_delivered_customer_date"),
        (d + _hours((30 + k % 11) * 24)).alias("order_estimated_delivery_date"),
    )


def derived_order_items(li: DataFrame, skew_safe: bool = True) -> DataFrame:
    """Items with ``order_item_id`` = position of the line inside its order.

    ``skew_safe`` (default) numbers lines with a range-partitioned rank, so
    an order holding a large share of all lines is spread over many tasks;
    ``skew_safe=False`` uses a window partitioned by the output key (one
    exchange that later per-order aggregates reuse) — cheaper, but a whole
    order must fit one task.
    """
    base = li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        "l_linenumber", "l_quantity")
    order = ["l_linenumber", "product_id", "seller_id", "price", "l_quantity", "shipping_limit_date"]
    if skew_safe:
        from ..operators.reshape import rank_within_key
        ranked = rank_within_key(base, "order_id", order, "order_item_id")
    else:
        ranked = base.withColumn("order_item_id", F.row_number().over(Window.partitionBy("order_id").orderBy(*order)))
    return ranked.select(
        "order_id", F.col("order_item_id").cast("bigint").alias("order_item_id"),
        "product_id", "seller_id", "shipping_limit_date", "price", "freight_value")


def _one_or_two(first_cond, first, second_cond, second) -> F.Column:
    """0–2 generated rows per input row from ONE scan instead of a union of
    two scans of the same table: explode a 2-element array whose absent
    entries are NULL (the caller drops them with a plain filter, which stays
    in codegen, unlike a higher-order ``filter``)."""
    return F.explode(F.array(F.when(first_cond, first), F.when(second_cond, second)))


def derived_order_reviews(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    score = (F.when(k % 211 == 0, F.lit(None).cast("bigint"))
             .when((k * 37) % 45 + 1 > 30 + k % 11, 1 + (k * 7) % 4)
             .otherwise(5 - ((k * 13) % 17) % 3))
    first = F.struct((k * 2).alias("review_id"), score.alias("review_score"))
    second = F.struct((k * 2 + 1).alias("review_id"),
                      (1 + F.expr("o_orderkey div 53") % 5).cast("bigint").alias("review_score"))
    r = o.select(k.alias("order_id"), F.col("o_orderdate").alias("review_creation_date"),
                 _one_or_two(k % 19 != 0, first, k % 53 == 0, second).alias("r")).filter(F.col("r").isNotNull())
    return r.select("r.review_id", "order_id", "r.review_score", "review_creation_date")


def derived_payments(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ptype = (F.when(k % 4 == 0, "boleto").when(k % 4 == 1, "voucher").otherwise("credit_card"))
    first = F.struct(F.lit(1).cast("bigint").alias("payment_sequential"), ptype.alias("payment_type"),
                     (1 + k % 10).alias("payment_installments"),
                     F.when(k % 10 == 0, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice"))
                     .alias("payment_value"))
    second = F.struct(F.lit(2).cast("bigint").alias("payment_sequential"), F.lit("voucher").alias("payment_type"),
                      F.lit(1).cast("bigint").alias("payment_installments"),
                      (F.col("o_totalprice") / 2).alias("payment_value"))
    p = o.select(k.alias("order_id"), _one_or_two(k % 307 != 0, first, k % 10 == 0, second).alias("p")) \
         .filter(F.col("p").isNotNull())
    return p.select("order_id", "p.payment_sequential", "p.payment_type", "p.payment_installments",
                    "p.payment_value")


def derived_customers(c: DataFrame, n: DataFrame) -> DataFrame:
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"),
        F.col("c_mktsegment").alias("customer_city"))


def derived_products(p: DataFrame) -> DataFrame:
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 40 == 0, F.lit(None)).otherwise(F.col("p_brand"))
        .alias("product_category_name"))


def derived_translation(p: DataFrame) -> DataFrame:
    # 'Brand#3' is left untranslated on purpose
    return (p.filter(F.col("p_brand") != "Brand#3")
            .select(F.col("p_brand").alias("product_category_name"),
                    F.concat(F.lit("en_"), F.lower("p_brand")).alias("product_category_name_english"))
            .distinct())


def derived_sellers(s: DataFrame, n: DataFrame) -> DataFrame:
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))


def derived_geolocation(n: DataFrame, r: DataFrame) -> DataFrame:
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("zip_prefix"), F.col("n_name").alias("state"),
        F.col("r_name").alias("city"))


class LazyCatalog(dict):
    """A table dict whose entries are built on first access (building the
    items table runs a hot-key check; queries that never read items skip it)."""

    def __init__(self, builders: dict):
        super().__init__({k: None for k in builders})
        self._builders = builders

    def __getitem__(self, name):
        v = super().__getitem__(name)
        if v is None:
            v = self._builders[name]()
            super().__setitem__(name, v)
        return v

    def get(self, name, default=None):
        return self[name] if name in self else default

    def items(self):
        return [(k, self[k]) for k in self.keys()]

    def values(self):
        return [self[k] for k in self.keys()]


def derived_catalog(spark: SparkSession, sf_dir: str, with_translation: bool = True,
                    skew_safe: bool = True) -> dict[str, DataFrame]:
    """The nine marketplace tables as lazy projections of the driver tables."""
    def t(name):
        return _read(spark, sf_dir, name)
    builders = {
        "orders": lambda: derived_orders(t("orders")),
        "order_items": lambda: derived_order_items(t("lineitem"), skew_safe),
        "order_reviews": lambda: derived_order_reviews(t("orders")),
        "customers": lambda: derived_customers(t("customer"), t("nation")),
        "products": lambda: derived_products(t("part")),
        "payments": lambda: derived_payments(t("orders")),
        "sellers": lambda: derived_sellers(t("supplier"), t("nation")),
        "geolocation": lambda: derived_geolocation(t("nation"), t("region")),
    }
    if with_translation:
        builders["product_translation"] = lambda: derived_translation(t("part"))
    return LazyCatalog(builders)
