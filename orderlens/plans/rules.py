"""Deterministic rule predictors over the modelling table.

They stand in for fitted models wherever an evaluation or analysis
operator must be checked value-for-value against SQL (a fitted MLlib
model's numbers depend on its solver). Each is a pure projection of the
data, so the checked operators run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rule classifiers, in their ordinal order.
RULE_CLASSIFIERS = ["late", "slow", "majority"]


def _rule(name: str):
    if name == "late":  # a late delivery predicts a bad review
        return F.when(F.coalesce(F.col("delivery_delay_days") > 0, F.lit(False)), 0).otherwise(1)
    if name == "slow":
        return F.when(F.coalesce(F.col("delivery_time_days") > 20, F.lit(False)), 0).otherwise(1)
    if name == "majority":
        return F.lit(1)
    raise ValueError(name)


def rule_classifications(md: DataFrame, names=None) -> DataFrame:
    """(model, ordinal, order_id, label, prediction) for labelled rows: one
    scan of the modelling table, one exploded row per rule."""
    names = names or RULE_CLASSIFIERS
    lab = md.filter(F.col("review_binary").isNotNull())
    preds = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ordinal"),
                                         _rule(n).alias("prediction")) for i, n in enumerate(names)])).alias("r")
    return lab.select("order_id", F.col("review_binary").cast("int").alias("label"), preds) \
              .select("r.model", "r.ordinal", "order_id", "label", "r.prediction")


def rule_regression(md: DataFrame) -> DataFrame:
    """(order_id, label = review_score, prediction = 4 − 0.2 · delay)."""
    p = F.lit(4.0) - F.lit(0.2) * F.coalesce(F.col("delivery_delay_days"), F.lit(0.0))
    return md.filter(F.col("review_score").isNotNull()).select(
        "order_id", F.col("review_score").alias("label"), p.alias("prediction"))


def rule_clusters(md: DataFrame) -> DataFrame:
    """A fixed 3-way segmentation: many items → 2, high spend → 0, else 1."""
    c = (F.when(F.col("n_items") >= 6, 2).when(F.col("total_items_price") >= 200000, 0).otherwise(1))
    return md.withColumn("cluster", c)
