"""Train/test split, folds, sampling and class weights.

Randomness is an arithmetic hash of the business key and a seed, never
``rand()``: the assignment does not depend on partitioning, survives
executor loss and recomputation, and is reproducible in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_bucket


def _key_col(df: DataFrame, key: str):
    t = df.schema[key].dataType.typeName()
    if t in ("long", "integer", "short", "byte"):
        return F.col(key)
    return F.abs(F.xxhash64(F.col(key))) % F.lit(2147483647)


def with_split(df: DataFrame, key: str = "order_id", test_size: float = 0.2, seed: int = 42,
               out: str = "is_test") -> DataFrame:
    """Flag ``test_size`` of the rows (in expectation) as test by key hash."""
    b = hash_bucket(_key_col(df, key), seed, 10000)
    return df.withColumn(out, b < F.lit(int(round(test_size * 10000))))


def train_test_split(df: DataFrame, key: str = "order_id", test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = with_split(df, key, test_size, seed, "_t")
    return s.filter(~F.col("_t")).drop("_t"), s.filter(F.col("_t")).drop("_t")


def with_folds(df: DataFrame, k: int = 3, key: str = "order_id", seed: int = 7, out: str = "fold") -> DataFrame:
    """Integer fold id in [0, k) by key hash (usable as ``foldCol``)."""
    return df.withColumn(out, hash_bucket(_key_col(df, key), seed, k).cast("int"))


HASH_SLICES = 4096  # ranges of the hash that are numbered apart


def _class_rank(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``df`` with ``_rank``, a row's number from 0 among its class in hash
    order, and ``_size``, its class's rows. Classes hold large shares of all
    rows, so rows are numbered inside ranges of the hash (a function of the
    key alone) and shifted by the counts of the ranges before."""
    hashed = df.withColumn("_h", hash_bucket(_key_col(df, key), seed, 1 << 32))
    hashed = hashed.withColumn("_slice", F.shiftright("_h", 32 - HASH_SLICES.bit_length() + 1))
    counts = hashed.groupBy(F.col(label).alias("_class"), F.col("_slice").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_class")
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_class", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("_size"))
    own = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h", key))
    ranked = hashed.withColumn("_own", own)
    return (ranked.join(counts, ranked[label].eqNullSafe(counts["_class"]) & (ranked["_slice"] == counts["_of"]))
            .withColumn("_rank", F.col("_before") + F.col("_own") - 1)
            .drop("_h", "_slice", "_class", "_of", "_before", "_own"))


def with_stratified_split(df: DataFrame, label: str = "label", key: str = "order_id", test_size: float = 0.2,
                          seed: int = 42, out: str = "is_test") -> DataFrame:
    """Flag ``test_size`` of each class's rows (rounded) as test."""
    r = _class_rank(df, label, key, seed)
    return r.withColumn(out, F.col("_rank") < F.floor(F.lit(test_size) * F.col("_size") + 0.5)).drop("_rank", "_size")


def stratified_split(df: DataFrame, label: str = "label", key: str = "order_id", test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = with_stratified_split(df, label, key, test_size, seed, "_t")
    return s.filter(~F.col("_t")).drop("_t"), s.filter(F.col("_t")).drop("_t")


def with_stratified_folds(df: DataFrame, k: int = 3, label: str = "label", key: str = "order_id", seed: int = 7,
                          out: str = "fold") -> DataFrame:
    """Fold ids in [0, k) whose sizes differ by one row at most in each class."""
    r = _class_rank(df, label, key, seed)
    return r.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def sample_n(df: DataFrame, n: int, key: str = "order_id", seed: int = 42, slack: float = 1.05) -> DataFrame:
    """Exactly ``min(n, count)`` rows: those with the ``n`` smallest seeded
    key hashes (ties by key).

    A plain ``orderBy(h).limit(n)`` sends every partition's top-n to one
    task (partitions × n rows). Instead the hash threshold that keeps about
    ``slack · n`` rows is derived from the row count (hashes are uniform on
    [0, 2^32)), verified with one count and raised until it keeps at least
    ``n`` rows; the final top-n then only sees ~n rows.
    """
    h = hash_bucket(_key_col(df, key), seed, 4294967296)
    hashed = df.withColumn("_h", h)
    total = df.count()
    if n >= total:
        return df
    frac = min(1.0, slack * n / total)
    while True:
        t = min(4294967296, int(frac * 4294967296) + 1)
        kept = hashed.filter(F.col("_h") < t)
        if t >= 4294967296 or kept.count() >= n:
            break
        frac = min(1.0, frac * 1.5)
    return kept.orderBy("_h", key).limit(n).drop("_h")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k · n_c) per class (k = number of classes)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    t = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(t)).select(
        label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach balanced weights. The class table has one row per class, so
    it is collected (bounded by classes) and applied as a literal map —
    no join, no shuffle of the data."""
    rows = class_weights(df, label).collect()
    m = F.create_map(*[x for r in rows for x in (F.lit(r[label]), F.lit(float(r["weight"])))])
    return df.withColumn(out, m[F.col(label)])
