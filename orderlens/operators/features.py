"""Feature frames and prediction-analysis tables.

Fitted statistics (quantiles, medians) are computed in as few aggregates as
possible and applied as literals, so the apply step stays a narrow,
codegen'd projection with no join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, col_, finite_or_null, log1p_nonneg, nan_inf_to_zero, score_bucket
from ..session import materialize
from .profile import _join_groups, _quantiles, box_stats
from .quantiles import global_quantiles, grouped_quantiles

# Feature lists of the supervised and clustering tasks.
NUMERIC_FEATURES = ["total_items_price", "total_freight_value", "payment_installments", "payment_value",
                    "n_items", "delivery_time_days", "estimated_delivery_days", "delivery_delay_days",
                    "review_count"]
CATEGORICAL_FEATURES = ["payment_type", "customer_state", "product_category_name_english"]
CLUSTER_FEATURES = ["total_items_price", "total_freight_value", "payment_value", "n_items",
                    "delivery_time_days", "delivery_delay_days"]
MONEY_FEATURES = ["total_items_price", "total_freight_value", "payment_value"]
CLUSTER_SUMMARY_COLUMNS = ["total_items_price", "total_freight_value", "payment_value", "n_items",
                           "delivery_time_days", "delivery_delay_days", "review_score"]


def feature_lists(df: DataFrame, numeric=None, categorical=None) -> tuple[list[str], list[str]]:
    """The default feature lists restricted to the columns present."""
    numeric = [c for c in (numeric or NUMERIC_FEATURES) if c in df.columns]
    categorical = [c for c in (categorical or CATEGORICAL_FEATURES) if c in df.columns]
    return numeric, categorical


def supervised_xy(df: DataFrame, target: str = "review_binary", key: str = "order_id",
                  target_type: str = "int", numeric=None, categorical=None) -> DataFrame:
    """Rows with a target, the feature columns and the target cast to
    ``target_type`` as ``label`` (the key is kept for write-back)."""
    num, cat = feature_lists(df, numeric, categorical)
    keep = [key] if key in df.columns else []
    return (df.filter(F.col(target).isNotNull())
            .select(*keep, *num, *cat, F.col(target).cast(target_type).alias("label")))


def quantile_bounds(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99,
                    accuracy: int | None = None) -> dict[str, tuple]:
    """{column: (lower quantile, upper quantile)} over non-null values.
    Exact by default (``operators.quantiles``); ``accuracy`` → approximate."""
    if accuracy is not None:
        row = df.agg(*[_quantiles(c, (lower, upper), accuracy).alias(c) for c in columns]).first()
        return {c: tuple(row[c]) if row[c] is not None else (None, None) for c in columns}
    q = global_quantiles(df, columns, (lower, upper))
    return {c: tuple(q[c]) for c in columns}


def apply_clip_bounds(df: DataFrame, bounds: dict[str, tuple], columns: list[str]) -> DataFrame:
    """Clamp each column to its fitted bounds (literals; NULL kept)."""
    return df.select(*[clip(c, *bounds[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def winsorize(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99,
              accuracy: int | None = None) -> DataFrame:
    """Per-column quantile clip (quantiles fitted on this same frame)."""
    return apply_clip_bounds(df, quantile_bounds(df, columns, lower, upper, accuracy), columns)


def cluster_features(df: DataFrame, key: str = "order_id", columns=None, accuracy: int | None = None) -> DataFrame:
    """Clustering frame: numeric coercion, ±inf → NULL, log1p of money
    (negative clipped to 0), 1–99 % winsorizing, complete finite rows."""
    cols = [c for c in (columns or CLUSTER_FEATURES) if c in df.columns]
    keep = [key] if key in df.columns else []
    x = df.select(*keep, *[finite_or_null(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(c) for c in cols])
    x = x.select(*keep, *[log1p_nonneg(c).alias(c) if c in MONEY_FEATURES else F.col(c) for c in cols])
    # fitted (quantiles) then applied: materialise the narrow frame once
    # instead of recomputing the upstream joins for each pass
    x = materialize(x)
    return winsorize(x, cols, accuracy=accuracy).dropna(subset=cols)


def clip_pred(df: DataFrame, pred: str = "prediction", lo: float = 1.0, hi: float = 5.0,
              out: str = "prediction_clipped") -> DataFrame:
    return df.withColumn(out, clip(pred, lo, hi))


def stabilize(df: DataFrame, columns: list[str], bound: float = 15.0) -> DataFrame:
    """NaN / ±inf → 0 then clamp to ±bound (NULL kept)."""
    return df.select(*[clip(nan_inf_to_zero(c), -bound, bound).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def cluster_names(df: DataFrame, cluster: str = "cluster", names: dict[int, str] | None = None,
                  out: str = "cluster_name") -> DataFrame:
    """Map cluster ids to display names (unknown ids → NULL)."""
    names = names or CLUSTER_NAMES
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, m[F.col(cluster)])


# Display names of the three segments (ids after renumbering by spend).
CLUSTER_NAMES = {
    0: "Alto Valor (1 produto, adiantado)",
    1: "Baixo Valor (adiantado, 1 produto)",
    2: "Multi-produtos (médio)",
}

# Short names for feature labels, applied in this order.
SHORT_NAMES = [
    ("product_category_name_english", "cat"),
    ("product_category_name", "cat"),
    ("payment_type", "pay"),
    ("customer_state", "state"),
    ("delivery_delay_days", "delay_days"),
    ("estimated_delivery_days", "eta_days"),
    ("delivery_time_days", "deliv_days"),
    ("total_items_price", "items_price"),
    ("total_freight_value", "freight"),
    ("payment_installments", "installments"),
    ("payment_value", "pay_value"),
]
SHORT_CLEANUP = [("cat__", "cat_"), ("num__", ""), (" ", "_")]


def short_feature_name(c) -> F.Column:
    """Chained literal replacements, in order, then prefix/space clean-up."""
    out = col_(c)
    for a, b in SHORT_NAMES + SHORT_CLEANUP:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def residual_frame(df: DataFrame, y: str = "label", pred: str = "prediction", lo: float = 1.0,
                   hi: float = 5.0) -> DataFrame:
    """y, clipped prediction, residual y − clip(pred), integer true bucket."""
    p = clip(pred, lo, hi)
    return df.select(F.col(y).cast("double").alias("y_true"), p.alias("y_pred"),
                     (F.col(y) - p).alias("residual"), score_bucket(y, int(lo), int(hi)).alias("y_true_bucket"))


def residual_bins(df: DataFrame, y: str = "label", pred: str = "prediction", lo: float = 1.0,
                  hi: float = 5.0, width: float = 0.25) -> DataFrame:
    """Mean and sample std of the residual per right-closed prediction bin
    (first bin closed at both ends); bins with an undefined std dropped.
    The first bin's displayed left edge is lo − 0.001 (interval display
    precision), so its centre is shifted by half of that."""
    r = residual_frame(df, y, pred, lo, hi).filter(F.col("y_pred").isNotNull())
    b = F.greatest(F.ceil((F.col("y_pred") - lo) / width), F.lit(1)).cast("int")
    g = r.groupBy(b.alias("bin")).agg(F.avg("residual").alias("mean_res"), F.stddev_samp("residual").alias("std_res"),
                                      F.count(F.lit(1)).alias("n"))
    left = F.lit(lo) + (F.col("bin") - 1) * width
    shown_left = F.when(F.col("bin") == 1, F.lit(lo - 0.001)).otherwise(left)
    return (g.filter(F.col("std_res").isNotNull() & F.col("mean_res").isNotNull())
            .select("bin", left.alias("bin_left"), (left + width).alias("bin_right"),
                    ((shown_left + left + width) / 2).alias("bin_center"), "mean_res", "std_res", "n"))


def residuals_by_score(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """Box statistics of the residual per rounded true score."""
    return box_stats(residual_frame(df, y, pred), "residual", ["y_true_bucket"])


def hexagons(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Counts by hexagon over the data's extent: (lattice, ix, iy, x, y, n), empty ones absent.

    Hexagon centres are two offset lattices of ``gridsize`` columns and gridsize / sqrt(3) rows; a point belongs
    to the nearer of its nearest centres of each (in units in which the hexagons are regular). One aggregate for
    the extent, one for the counts, of at most twice as many hexagons as the lattice has points."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    e = d.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    columns, rows = gridsize, int(gridsize / math.sqrt(3))
    (x0, wide), (y0, high) = (_lattice(e[0], e[1], columns), _lattice(e[2], e[3], rows))
    at = d.select(((F.col("x") - x0) / wide).alias("u"), ((F.col("y") - y0) / high).alias("v"))
    whole, half = [(F.bround(c), F.floor(c)) for c in (F.col("u"), F.col("v"))], 0.5
    near = F.pow(F.col("u") - whole[0][0], F.lit(2.0)) + 3 * F.pow(F.col("v") - whole[1][0], F.lit(2.0))
    far = F.pow(F.col("u") - whole[0][1] - half, F.lit(2.0)) + 3 * F.pow(F.col("v") - whole[1][1] - half, F.lit(2.0))
    first = near < far
    cell = at.select(F.when(first, 0).otherwise(1).alias("lattice"), F.when(first, whole[0][0]).otherwise(whole[0][1]).cast("int").alias("ix"),
                     F.when(first, whole[1][0]).otherwise(whole[1][1]).cast("int").alias("iy"))
    shift = F.col("lattice") * half
    return cell.groupBy("lattice", "ix", "iy").agg(F.count(F.lit(1)).alias("n")).select(
        "lattice", "ix", "iy", ((F.col("ix") + shift) * wide + x0).alias("x"), ((F.col("iy") + shift) * high + y0).alias("y"), "n")


def _lattice(lo, hi, cells: int) -> tuple[float, float]:
    """(origin, spacing) of one axis; an axis of one value has a width of its own."""
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    return (lo, (hi - lo) / cells) if hi > lo else (lo - 0.5, 1.0 / cells)


def pred_histogram(df: DataFrame, y: str = "label", pred: str = "prediction", lo: float = 1.0, hi: float = 5.0, bins: int = 20) -> DataFrame:
    """Counts of clipped predictions by rounded true score and bin: (y_true_bucket, bin, bin_left, bin_right, n)."""
    r = residual_frame(df, y, pred, lo, hi).dropna(subset=["y_true_bucket", "y_pred"])
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("y_pred") - lo) / width), F.lit(bins - 1)).cast("int")
    return r.groupBy("y_true_bucket", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "y_true_bucket", "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_left"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_right"), "n")


def pred_density(df: DataFrame, y: str = "label", pred: str = "prediction", points: int = 101) -> DataFrame:
    """Gaussian kernel density of clipped predictions by rounded true score: (y_true_bucket, point, x, density).

    Each score has a grid of ``points`` over the extent of its predictions (not beyond it) and the bandwidth
    std * n**(-1/5). A value's weight is shared linearly by its two neighbouring grid points, so that one aggregate
    leaves at most ``points`` weights a score, and the density is their convolution with the kernel. A score
    whose predictions are all equal has one point and no density."""
    r = residual_frame(df, y, pred).dropna(subset=["y_true_bucket", "y_pred"]).select("y_true_bucket", "y_pred")
    r = materialize(r)  # read for the extents and for the weights
    size = r.groupBy("y_true_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("y_pred").alias("lo"), F.max("y_pred").alias("hi"),
                                          F.stddev_samp("y_pred").alias("s"))
    size = size.select("y_true_bucket", "n", "lo", ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
                       (F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h")).withColumn("h", F.when(F.col("h") > 0, F.col("h")))
    place = F.when(F.col("step") > 0, (F.col("y_pred") - F.col("lo")) / F.col("step")).otherwise(0.0)
    at = r.join(size, "y_true_bucket").select("y_true_bucket", place.alias("p")).withColumn("i", F.least(F.floor("p"), F.lit(points - 2)).cast("int"))
    share = F.explode(F.array(F.struct(F.col("i").alias("i"), (1 - (F.col("p") - F.col("i"))).alias("w")),
                              F.struct((F.col("i") + 1).alias("i"), (F.col("p") - F.col("i")).alias("w")))).alias("g")
    weights = at.select("y_true_bucket", share).groupBy("y_true_bucket", F.col("g.i").alias("i")).agg(F.sum("g.w").alias("w")).where("w > 0")
    last = F.when(F.col("step") > 0, points - 1).otherwise(0)
    grid = size.select("*", F.explode(F.sequence(F.lit(0), last)).alias("point"))
    away = (F.col("point") - F.col("i")) * F.col("step") / F.col("h")
    kernel = F.sum(F.col("w") * F.exp(-0.5 * away * away))
    return grid.join(weights, "y_true_bucket").groupBy("y_true_bucket", "point", "lo", "step", "n", "h").agg(kernel.alias("k")).select(
        "y_true_bucket", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        F.when(F.col("h") > 0, F.col("k") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def pred_distribution(df: DataFrame, y: str = "label", pred: str = "prediction",
                      accuracy: int | None = None) -> DataFrame:
    """Distribution of clipped predictions per rounded true score:
    n, min, quartiles, max (the table behind a violin plot)."""
    r = residual_frame(df, y, pred)
    if accuracy is None:  # quartiles take passes of their own: run what is upstream once
        r = materialize(r.select("y_true_bucket", "y_pred"))
    base = [F.count("y_pred").alias("n"), F.min("y_pred").alias("min"), F.max("y_pred").alias("max")]
    if accuracy is None:
        small = grouped_quantiles(r, ["y_true_bucket"], ["y_pred"], (0.25, 0.5, 0.75), ("q1", "median", "q3"))
        out = _join_groups(r.groupBy("y_true_bucket").agg(*base), small, ["y_true_bucket"])
        return out.select("y_true_bucket", "n", "min", F.col("y_pred__q1").alias("q1"),
                          F.col("y_pred__median").alias("median"), F.col("y_pred__q3").alias("q3"), "max")
    return r.groupBy("y_true_bucket").agg(
        *base, _quantiles("y_pred", (0.25, 0.5, 0.75), accuracy).alias("_q")
    ).select("y_true_bucket", "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
             F.col("_q")[2].alias("q3"), "max")


def feature_defaults(df: DataFrame, numeric: list[str], categorical: list[str], max_values: int | None = None,
                     accuracy: int | None = None) -> DataFrame:
    """Input defaults per feature: numeric → p1 (min), p99 (max), median
    (value); categorical → all distinct non-null values, or the first
    ``max_values`` in ascending order where the caller asks for so many."""
    if accuracy is None:
        q = global_quantiles(df, numeric, (0.01, 0.99, 0.5))
        rows = [(c, "numeric", *[None if v is None else float(v) for v in q[c]]) for c in numeric]
    else:
        r = df.agg(*[_quantiles(c, (0.01, 0.99, 0.5), accuracy).alias(c) for c in numeric]).first()
        rows = [(c, "numeric", *(r[c] or [None, None, None])) for c in numeric]
    num = df.sparkSession.createDataFrame(rows, "feature string, kind string, min double, max double, value double") \
        .select("*", F.lit(None).cast("string").alias("category"))
    if not categorical:
        return num
    # all categorical columns in one scan
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
                                for c in categorical))).alias("p")
    found = df.select(pairs).select("p.*").filter(F.col("category").isNotNull()).distinct()
    if max_values is not None:
        found = reduce(DataFrame.unionByName, [found.filter(F.col("feature") == c).orderBy("category").limit(max_values)
                                               for c in categorical])
    none = F.lit(None).cast("double")
    return num.unionByName(found.select("feature", F.lit("categorical").alias("kind"), none.alias("min"),
                                        none.alias("max"), none.alias("value"), "category"))
