"""Drivers of the review score: delay correlation, late flag, worst
categories and states.

The reference's questions fan reviews out over items (a review counts once
per item of its order). Materialising that fan-out multiplies rows and puts
a hot order's items in one join task; instead both sides are reduced to the
order key first (reviews → count / Σ score / # bad per order; items →
count per (order, category)), joined one-to-few on ``order_id``, and the
per-category totals are products of the two counts — the same numbers as
the fan-out, with no skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import day_diff, late_flag, yes_no


_FIXED_WIDTH = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType,
                T.DateType, T.TimestampType, T.TimestampNTZType)


def dedup_first(df: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the lowest ``order`` value.

    An aggregate (``min_by`` of a struct), not a window: it combines on the
    map side, so a key holding a large share of rows is not sorted in one
    task.
    """
    cols = columns or [c for c in df.columns if c != key]
    d = df.filter(F.col(key).isNotNull())
    if all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in cols):
        # fixed-width values: one min_by per column under the same ordering
        # (strict comparison over the same row sequence → the same row) keeps
        # a hash aggregate; a struct value would force a sort-based one
        return d.groupBy(key).agg(*[F.min_by(c, F.col(order)).alias(c) for c in cols])
    best = F.min_by(F.struct(*cols), F.col(order)).alias("_r")
    return d.groupBy(key).agg(best).select(key, "_r.*")


def order_delay(orders: DataFrame) -> DataFrame:
    """order_id, customer_id, delivery_delay_days of every order."""
    return orders.select("order_id", "customer_id",
                         day_diff("order_delivered_customer_date", "order_estimated_delivery_date")
                         .alias("delivery_delay_days"))


def scored_reviews(reviews: DataFrame) -> DataFrame:
    return (reviews.filter(F.col("review_score").isNotNull())
            .withColumn("review_score", F.col("review_score").cast("double")))


def reviews_with_delay(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Scored reviews ⟕ orders (delay, customer): one row per review."""
    return scored_reviews(reviews).join(order_delay(orders), "order_id", "left")


def corr_delay_score(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Pearson correlation of score and delay over reviews with both present."""
    ro = reviews_with_delay(reviews, orders).dropna(subset=["review_score", "delivery_delay_days"])
    return ro.agg(F.corr("review_score", "delivery_delay_days").alias("corr_delay_score"),
                  F.count(F.lit(1)).alias("n"))


def review_by_late_flag(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean score and number of reviews by late flag (missing delay = not late)."""
    ro = reviews_with_delay(reviews, orders).withColumn("delayed", late_flag("delivery_delay_days"))
    return ro.groupBy("delayed").agg(F.avg("review_score").alias("mean_score"),
                                     F.count(F.lit(1)).alias("n_reviews")) \
             .withColumn("delayed_label", yes_no("delayed"))


def delay_by_score_rows(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """orders ⋈ first review per order (lowest review_id): delay and score,
    complete rows only."""
    first = dedup_first(reviews.select("order_id", "review_id", "review_score"), "order_id", "review_id")
    o = order_delay(orders).select("order_id", "delivery_delay_days")
    return (o.join(first, "order_id", "inner")
            .dropna(subset=["delivery_delay_days", "review_score"])
            .select("order_id", F.col("review_score").cast("double").alias("review_score"),
                    "delivery_delay_days"))


def _review_totals(reviews: DataFrame) -> DataFrame:
    s = F.col("review_score")
    return scored_reviews(reviews).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_nr"), F.sum(s).alias("_sr"),
        F.sum(F.when(s <= 2, 1).otherwise(0)).alias("_br"))


def _group_stats(df: DataFrame, key: str, weight) -> DataFrame:
    w = weight
    return df.groupBy(key).agg(
        F.sum(F.col("_nr") * w).alias("n_reviews"),
        (F.sum(F.col("_sr") * w) / F.sum(F.col("_nr") * w)).alias("mean_score"),
        (F.sum(F.col("_br") * w) * 100.0 / F.sum(F.col("_nr") * w)).alias("pct_bad"))


def category_review_stats(reviews: DataFrame, items: DataFrame, products: DataFrame,
                          category: str = "product_category_name") -> DataFrame:
    """Per category: size, mean score, % of scores ≤ 2 over the review × item
    fan-out (NULL categories dropped), computed without the fan-out."""
    cat_items = (items.select("order_id", "product_id")
                 .join(products.select("product_id", category), "product_id", "left")
                 .filter(F.col(category).isNotNull())
                 .groupBy("order_id", category).agg(F.count(F.lit(1)).alias("_ni")))
    return _group_stats(_review_totals(reviews).join(cat_items, "order_id"), category, F.col("_ni"))


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def worst_categories(reviews: DataFrame, items: DataFrame, products: DataFrame,
                     min_count: int = 50, top_n: int = 10) -> DataFrame:
    """Categories with the highest share of bad (≤ 2) scores among those
    with at least ``min_count`` (review, item) rows."""
    st = category_review_stats(reviews, items, products).filter(F.col("n_reviews") >= min_count)
    return top_k(st, [F.desc("pct_bad"), F.asc("product_category_name")], top_n)


def overall_bad_rate_categories(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """% of bad scores over the full review × item fan-out (reviews of orders
    without items count once)."""
    ni = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_ni"))
    j = _review_totals(reviews).join(ni, "order_id", "left")
    w = F.greatest(F.coalesce(F.col("_ni"), F.lit(0)), F.lit(1))
    return j.agg((F.sum(F.col("_br") * w) * 100.0 / F.sum(F.col("_nr") * w)).alias("pct_bad"),
                 F.sum(F.col("_nr") * w).alias("n_rows"))


def state_review_stats(reviews: DataFrame, orders: DataFrame, customers: DataFrame,
                       state: str = "customer_state") -> DataFrame:
    geo = (_review_totals(reviews)
           .join(orders.select("order_id", "customer_id"), "order_id", "left")
           .join(customers.select("customer_id", state), "customer_id", "left")
           .filter(F.col(state).isNotNull()))
    return _group_stats(geo, state, F.lit(1))


def worst_states(reviews: DataFrame, orders: DataFrame, customers: DataFrame,
                 min_count: int = 100, top_n: int = 10) -> DataFrame:
    """States with the lowest mean score among those with ≥ ``min_count`` reviews."""
    st = state_review_stats(reviews, orders, customers).filter(F.col("n_reviews") >= min_count)
    return top_k(st, [F.asc("mean_score"), F.asc("customer_state")], top_n)


def overall_bad_rate_states(reviews: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """% bad over reviews ⟕ orders ⟕ customers: a review counts once for each row that its order and the
    order's customer have there, and once without any."""
    held = customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_nc"))
    per = orders.select("order_id", "customer_id").join(held, "customer_id", "left").groupBy("order_id").agg(
        F.sum(F.greatest(F.coalesce("_nc", F.lit(0)), F.lit(1))).alias("_no"))
    j = _review_totals(reviews).join(per, "order_id", "left")
    w = F.greatest(F.coalesce(F.col("_no"), F.lit(0)), F.lit(1))
    return j.agg((F.sum(F.col("_br") * w) * 100.0 / F.sum(F.col("_nr") * w)).alias("pct_bad"),
                 F.sum(F.col("_nr") * w).alias("n_rows"))
