"""Per-order consolidation: aggregates to ``order_id`` and the left joins.

Plan shape: each child table (reviews, items, payments) is aggregated to
the order key *before* joining (map-side partial aggregation, so a hot
order is combined on the map side and never fans out). The three
aggregates and the orders table are then all hash-partitioned on
``order_id``; the three left joins reuse that one partitioning (one
exchange per input, none between the joins). Customers and products are
joined on their own keys; Spark broadcasts them only when their measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at
runtime), else it shuffles (and AQE splits skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, negative_target, not_equal_keep_null, positive_target, \
    strict_binary_target, weekday_mon0


def drop_canceled(orders: DataFrame, status_col: str = "order_status",
                  canceled: str = "canceled") -> DataFrame:
    """Remove cancelled orders; a NULL status is kept."""
    return orders.filter(not_equal_keep_null(status_col, canceled))


def reviews_agg(reviews: DataFrame, key: str = "order_id") -> DataFrame:
    """Mean score and number of non-null review ids per order (NULL keys dropped)."""
    return (reviews.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.avg(F.col("review_score").cast("double")).alias("review_score"),
                 F.count("review_id").alias("review_count")))


def _ordered_list(value: str, order: str) -> F.Column:
    # list in item order, NULL values kept: sort (order, value) structs, project value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))),
                       lambda x: x["v"])


def items_agg(items: DataFrame, key: str = "order_id", lists: bool = True,
              first_product: bool = False) -> DataFrame:
    """Per order: item count, Σ price, Σ freight (0.0 when all NULL).

    ``lists=True`` adds ``product_ids`` / ``sellers_ids`` in item order.
    Lists are bounded by the items of one order; they are the only
    non-combinable part of this aggregate, so leave them off on data where
    a single order may hold a large share of all items (the long form is
    the items table itself). ``first_product=True`` adds the product of
    the lowest ``order_item_id`` among non-null products (``min_by``,
    partially aggregated, no sort).
    """
    aggs = [F.count("order_item_id").alias("n_items")]
    if lists:
        aggs.append(_ordered_list("product_id", "order_item_id").alias("product_ids"))
    aggs += [F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_items_price"),
             F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("total_freight_value")]
    if lists:
        aggs.append(_ordered_list("seller_id", "order_item_id").alias("sellers_ids"))
    if first_product:
        # min_by skips rows whose ordering is NULL: order only non-null products
        aggs.append(F.min_by("product_id", F.when(F.col("product_id").isNotNull(), F.col("order_item_id")))
                    .alias("first_product_id"))
    return items.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def payments_agg(payments: DataFrame, key: str = "order_id") -> DataFrame:
    """Max sequential, type of the first payment (lowest sequential, even if
    NULL), max installments, Σ value (0.0 when all NULL)."""
    return (payments.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.max("payment_sequential").alias("payment_sequential"),
                 F.min_by("payment_type", "payment_sequential").alias("payment_type"),
                 F.max("payment_installments").alias("payment_installments"),
                 F.coalesce(F.sum("payment_value"), F.lit(0.0)).alias("payment_value")))


def first_item(items: DataFrame, key: str = "order_id") -> DataFrame:
    """First non-null product per order by ``order_item_id``."""
    return (items_agg(items, key, lists=False, first_product=True)
            .select(key, F.col("first_product_id").alias("product_id")))


def base_orders(data: dict[str, DataFrame], drop_canceled_orders: bool = True,
                item_lists: bool = False, key: str = "order_id") -> DataFrame:
    """One row per order: orders ⟕ reviews ⟕ items ⟕ payments ⟕ customers
    ⟕ first-item category ⟕ translation (when the table is present)."""
    orders = data["orders"]
    if drop_canceled_orders:
        orders = drop_canceled(orders)
    items = items_agg(data["order_items"], key, lists=item_lists, first_product=True)
    df = (orders
          .join(reviews_agg(data["order_reviews"], key), key, "left")
          .join(items, key, "left")
          .join(payments_agg(data["payments"], key), key, "left")
          .join(data["customers"], "customer_id", "left"))
    products = data["products"].select(F.col("product_id").alias("first_product_id"), "product_category_name")
    if "product_translation" in data:
        # translate the (small) product dimension first: the order-level table
        # then takes one join on the product key instead of two shuffles
        products = products.join(data["product_translation"], "product_category_name", "left")
    # orders without an item have no product: a second key, 0 for all products, deals them to many
    # tasks instead of the one of NULL (it is computed on both sides, as the optimizer drops constants)
    spread = F.when(F.col("first_product_id").isNull(), F.xxhash64(key)).otherwise(F.lit(0))
    df = (df.withColumn("_spread", spread)
          .join(products.withColumn("_spread", F.pmod(F.xxhash64("first_product_id"), F.lit(1))),
                ["first_product_id", "_spread"], "left").drop("first_product_id", "_spread"))
    lead = [c for c in orders.columns] + [c for c in ("review_score", "review_count", "n_items", "product_ids",
                                                      "total_items_price", "total_freight_value", "sellers_ids",
                                                      "payment_sequential", "payment_type", "payment_installments",
                                                      "payment_value") if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def add_time_features(df: DataFrame, purchase: str = "order_purchase_timestamp",
                      delivered: str = "order_delivered_customer_date",
                      estimated: str = "order_estimated_delivery_date") -> DataFrame:
    """Delivery time, estimated time and delay in whole (floored) days, plus
    year, month and Monday-0 weekday of the purchase."""
    return df.select("*",
                     day_diff(delivered, purchase).alias("delivery_time_days"),
                     day_diff(estimated, purchase).alias("estimated_delivery_days"),
                     day_diff(delivered, estimated).alias("delivery_delay_days"),
                     F.year(purchase).alias("purchase_year"),
                     F.month(purchase).alias("purchase_month"),
                     weekday_mon0(purchase).alias("purchase_dayofweek"))


def add_targets(df: DataFrame, score: str = "review_score") -> DataFrame:
    """review_positive (≥4), review_negative (≤2) as 0/1 and the strict
    binary target (1/0/NULL)."""
    return df.select("*", positive_target(score).alias("review_positive"),
                     negative_target(score).alias("review_negative"),
                     strict_binary_target(score).alias("review_binary"))


def require_score(df: DataFrame, score: str = "review_score") -> DataFrame:
    return df.filter(F.col(score).isNotNull())


def model_dataset(data: dict[str, DataFrame], drop_canceled_orders: bool = True,
                  item_lists: bool = False) -> DataFrame:
    """The modelling table: base → time features → rows with a score → targets. ``item_lists`` adds each order's
    product and seller ids (the written table has them; analyses that don't read them leave them out)."""
    return (base_orders(data, drop_canceled_orders, item_lists)
            .transform(add_time_features)
            .transform(require_score)
            .transform(add_targets))
