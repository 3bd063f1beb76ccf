"""Profiling and descriptive statistics.

Every statistic is one aggregate pass; quantiles are exact (linear
interpolation, like numpy) by radix selection, see ``operators.quantiles``,
unless ``accuracy`` is given, which switches to ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col_, hash_bucket
from ..session import materialize
from .quantiles import global_quantiles, grouped_quantiles


def _join_groups(left: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe join of per-group results on the group keys."""
    r = small.select(*[F.col(b).alias(f"_k_{b}") for b in by], *[c for c in small.columns if c not in by])
    cond = None
    for b in by:
        e = left[b].eqNullSafe(r[f"_k_{b}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left").drop(*[f"_k_{b}" for b in by])


BROADCAST_ROWS = 10_000  # rows of results, of some KB at most, that travel to the rows they are joined to


def _few(stored: DataFrame) -> DataFrame:
    """A ``stored`` result, broadcast unless it has many rows, so that what it is joined to stays where it is."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def _quantiles(c, qs, accuracy=None):
    c = col_(c).cast("double")
    if accuracy is None:
        return F.percentile(c, list(qs))
    return F.percentile_approx(c, list(qs), accuracy)


def table_shapes(catalog: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_cols) for every table: one count per table, unioned."""
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("int").alias("n_cols"))
              for name, df in catalog.items()]
    return reduce(DataFrame.unionByName, frames)


def dtypes_frame(df: DataFrame, spark=None) -> DataFrame:
    """``df.dtypes`` as a (column, dtype) DataFrame (metadata only, no scan)."""
    spark = spark or df.sparkSession
    return spark.createDataFrame(df.dtypes, "column string, dtype string")


def _is_missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_profile(df: DataFrame, table: str = "table") -> DataFrame:
    """% missing per column (NULL or NaN), only columns with any, rounded
    half-even to 2 places, descending (ties by column name)."""
    aggs = [F.avg(F.when(_is_missing(df, c), 1.0).otherwise(0.0)).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot([], df.columns, "column", "frac")
    return (long.filter(F.col("frac") > 0)
            .select(F.lit(table).alias("table"), "column",
                    F.bround(F.col("frac") * 100, 2).alias("pct_missing")))


def missing_profile_catalog(catalog: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [missing_profile(df, name) for name, df in catalog.items()])


def preview(df: DataFrame, columns: list[str], n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The available ``columns`` of the first ``n`` rows by an explicit order
    (Spark has no file order; ``TakeOrderedAndProject``, no full sort)."""
    cols = [c for c in columns if c in df.columns]
    order = order_by or cols[:1]
    return df.select(*cols).orderBy(*order).limit(n)


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns not present (a warning list, no scan)."""
    present = set(df.columns)
    return [c for c in expected if c not in present]


def describe(df: DataFrame, value: str, by: list[str] | None = None, digits: int | None = 2,
             accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, p25, p50, p75, max of ``value`` (NULLs
    skipped), optionally per group, rounded half-even to ``digits``."""
    by = by or []
    v = F.col(value).cast("double")
    r = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    base = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max")]
    tail = [r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("min")).alias("min")]
    qn = ("p25", "p50", "p75")
    if accuracy is None:  # quartiles take passes of their own: run what is upstream once
        df = materialize(df.select(*by, v.alias(value)))
        v = F.col(value)
    if accuracy is None and by:
        agg = _join_groups(df.groupBy(*by).agg(*base), grouped_quantiles(df, by, [value], (0.25, 0.5, 0.75), qn), by)
        return agg.select(*by, "count", *tail, *[r(F.col(f"{value}__{n}")).alias(n) for n in qn],
                          r(F.col("max")).alias("max"))
    if accuracy is None:
        qv = global_quantiles(df, [value], (0.25, 0.5, 0.75))[value]
        agg = df.agg(*base)
        return agg.select("count", *tail, *[r(F.lit(x).cast("double")).alias(n) for x, n in zip(qv, qn)],
                          r(F.col("max")).alias("max"))
    q = _quantiles(value, (0.25, 0.5, 0.75), accuracy)
    agg = (df.groupBy(*by) if by else df).agg(*base, q.alias("_q"))
    return agg.select(*by, "count", *tail, r(F.col("_q")[0]).alias("p25"),
                      r(F.col("_q")[1]).alias("p50"), r(F.col("_q")[2]).alias("p75"),
                      r(F.col("max")).alias("max"))


def box_stats(df: DataFrame, value: str, by: list[str], whisker: float = 1.5,
              accuracy: int | None = None) -> DataFrame:
    """Box-plot statistics per group: quartiles, whiskers at the most
    extreme datum within ``whisker``·IQR of the box, outlier count.

    The exact quartiles of each group come first (``operators.quantiles``);
    then one pass joins them back (one row per group)
    and takes conditional min / max / count in a single aggregate.
    """
    v = F.col(value).cast("double")
    data = materialize(df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull()))
    if accuracy is None:
        small = grouped_quantiles(data, by, ["_v"], (0.25, 0.5, 0.75), ("q1", "median", "q3"))
        q = small.select(*by, F.col("_v__q1").alias("q1"), F.col("_v__median").alias("median"),
                         F.col("_v__q3").alias("q3"))
    else:
        q = data.groupBy(*by).agg(_quantiles("_v", (0.25, 0.5, 0.75), accuracy).alias("_q"))
        q = q.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("lo_fence", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    j = _join_groups(data, q, by)
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"))


def mean_ci(df: DataFrame, value: str, by: list[str] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Mean with a normal-theory 95 % interval (mean ± z·s/√n) per group."""
    by = by or []
    v = F.col(value).cast("double")
    a = (df.groupBy(*by) if by else df).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                           F.stddev_samp(v).alias("std"))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n"))
    return a.select(*by, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


EXACT_MEAN = 64  # up to which a Poisson draw inverts its distribution
MOST_DRAWN = 200  # that a draw of such a mean gives (more has a chance below 1e-40)


def _replicates(rows: DataFrame, key: Callable[[Column], Column], n_boot: int, seed: int) -> DataFrame:
    """``rows`` for each replicate ``_b``, with two uniform draws in (0, 1) that hash ``key(_b)``."""
    rep = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_b"))
    u, v = ((hash_bucket(key(F.col("_b")), s, 1 << 32) + 0.5) / float(1 << 32) for s in (seed, seed + 1))
    return rep.select("*", u.alias("_u"), v.alias("_v2"))


def _with_poisson(rep: DataFrame, means: DataFrame) -> DataFrame:
    """``rep`` with a Poisson draw ``_w`` of mean ``_mean``: up to ``EXACT_MEAN`` the inverse of the distribution at
    ``_u``, beyond it a normal draw with the Cornish-Fisher term for Poisson's skew, rounded. ``means`` has a row
    for each mean that occurs."""
    mean = F.col("_mean")

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["upto"] + p).alias("upto"), F.concat(s["f"], F.array(s["upto"] + p)).alias("f"))
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), zero.alias("upto"), F.array(zero).alias("f"))
    exact = materialize(means.where(mean <= EXACT_MEAN).distinct())
    steps = _few(exact).select(
        mean.alias("_of"), F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DRAWN)), start, step)["f"].alias("_f"))
    u, v = F.col("_u"), F.col("_v2")
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    large = F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + 0.5))
    small = F.size(F.filter("_f", lambda f: f <= u)).cast("double")
    return rep.join(steps, F.col("_mean") == F.col("_of"), "left").withColumn("_w", F.when(mean <= EXACT_MEAN, small).otherwise(large)).drop("_of", "_f")


def mean_ci_bootstrap(df: DataFrame, value: str, by: list[str], n_boot: int = 1000, seed: int = 42,
                      level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean per group, for columns of few values, such as scores.

    The data are first reduced to distinct (group, value) counts: in a replicate a value seen ``c`` times weighs
    the total of ``c`` Poisson(1) draws, a Poisson(c) draw. Draws hash (the value's place among its group's values,
    replicate, seed), so they depend neither on partitions nor on recomputation. The counts are exploded ``n_boot``
    times; for columns of many values see :func:`mean_ci_bags`.
    """
    v = F.col(value).cast("double")
    hist = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_v"))
    hist = materialize(hist.select(*by, "_v", F.col("_c").cast("double").alias("_mean"), place.alias("_i")))
    rep = _replicates(hist, lambda b: F.col("_i") * n_boot + b, n_boot, seed)
    reps = _with_poisson(rep, hist.select("_mean")).groupBy(*by, "_b").agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_m"))
    return _with_interval(df, value, by, reps, [], level)


def _with_interval(df: DataFrame, value: str, by: list[str], reps: DataFrame, bags: list[str], level: float) -> DataFrame:
    """n and mean of the data, and the replicates' interval (averaged over bags)."""
    v = F.col(value).cast("double")
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = reps.groupBy(*by, *bags).agg(F.percentile("_m", [lo, hi]).alias("_ci"))  # as many values as replicates
    ci = ci.groupBy(*by).agg(F.avg(F.col("_ci")[0]).alias("ci_low"), F.avg(F.col("_ci")[1]).alias("ci_high"))
    return _join_groups(df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean")), ci, by).where(F.col("ci_low").isNotNull())


def mean_ci_bags(df: DataFrame, value: str, by: list[str], key: str, bags: int = 10, power: float = 0.6, n_boot: int = 100,
                 seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of the mean per group by bags of little bootstraps, for columns of many values.

    Each of ``bags`` bags has about n**power of a group's n rows, drawn by hashes of the key; a replicate weighs a
    bag's rows by Poisson(n / rows of the bag) draws, so that it stands for all n, and the bags' intervals are
    averaged. Only the bags' rows, bags * n**power of them, are exploded ``n_boot`` times.
    """
    # what is upstream runs once, for the groups' sizes and for the bags
    rows = materialize(df.select(*by, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v")))
    sizes = materialize(rows.where(F.col("_v").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    share = F.pow(F.col("_n"), F.lit(power - 1.0))
    taken = F.array(*(F.when(hash_bucket("_key", seed + 100 + j, 1 << 32) < share * float(1 << 32), j) for j in range(bags)))
    drawn = _join_groups(rows.where(F.col("_v").isNotNull()), _few(sizes), by).select(*by, "_key", "_v", "_n", taken.alias("_bags"))
    drawn = materialize(drawn.select(*by, "_key", "_v", "_n", F.explode("_bags").alias("_bag")).where(F.col("_bag").isNotNull()))
    held = materialize(drawn.groupBy(*by, "_bag").agg(F.count(F.lit(1)).alias("_size")))
    drawn = _join_groups(drawn, _few(held), [*by, "_bag"]).select(*by, "_bag", "_key", "_v", (F.col("_n") / F.col("_size")).alias("_mean"))
    drawn = drawn.withColumn("_key", hash_bucket("_key", seed + 7, 1 << 32))
    rep = _replicates(drawn, lambda b: F.col("_key") + F.col("_bag") * 1_000_003 + b.cast("long") * 7_919, n_boot, seed)
    reps = _with_poisson(rep, drawn.select("_mean")).groupBy(*by, "_bag", "_b").agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_m"))
    return _with_interval(rows, "_v", by, reps, ["_bag"], level)


def score_distribution(reviews: DataFrame, score: str = "review_score") -> DataFrame:
    """Count per score, % of all reviews (NULL scores in the denominator) and
    the mean count per (non-null) score."""
    g = reviews.groupBy(score).agg(F.count(F.lit(1)).alias("n_reviews"))
    tot = g.agg(F.sum("n_reviews").alias("_total"),
                F.avg(F.when(F.col(score).isNotNull(), F.col("n_reviews"))).alias("mean_count_per_score"))
    return (g.filter(F.col(score).isNotNull()).crossJoin(F.broadcast(tot))  # 1-row side
            .select(score, "n_reviews", (F.col("n_reviews") * 100.0 / F.col("_total")).alias("pct_reviews"),
                    "mean_count_per_score"))


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``value_counts(dropna=False)`` of several columns as (column, value, n):
    one scan that emits a (column, value) struct per column and one grouped
    count (partially aggregated), instead of one scan per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def orders_per_month(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Orders per calendar month of the purchase time (NULL times dropped)."""
    m = F.trunc(F.to_date(ts), "month")
    return (orders.filter(F.col(ts).isNotNull()).groupBy(m.alias("purchase_month"))
            .agg(F.count(F.lit(1)).alias("n_orders_month")))


def period_covered(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    return orders.agg(F.min(ts).alias("min_purchase"), F.max(ts).alias("max_purchase"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
