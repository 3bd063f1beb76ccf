"""Reshaping, ranking and coercion helpers over bounded or whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coerce_timestamps(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Parse the given columns to TIMESTAMP_NTZ; unparsable values → NULL
    (``to_datetime(errors='coerce')``-style, safe under ANSI mode)."""
    out = df
    for c in columns:
        parsed = F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)) if fmt else \
            F.try_to_timestamp(F.col(c).cast("string"))
        out = out.withColumn(c, parsed.cast("timestamp_ntz"))
    return out


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """``to_numeric(errors='coerce')``: try-cast to double, failures → NULL."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def translate(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Left join of a (small) lookup table; unmatched keys → NULL."""
    return df.join(mapping, key, "left")


def unpivot_long(df: DataFrame, ids: list[str], values: list[str], var: str = "variable",
                 val: str = "value") -> DataFrame:
    """Wide → long (``melt``)."""
    return df.unpivot(ids, values, var, val)


def rest_after_top(df: DataFrame, order: list, n: int, partition: list[str] | None = None) -> DataFrame:
    """Rows ranked after the first ``n`` (``iloc[n:]``). Without
    ``partition`` the first ``n`` are a top-k, which every task thins before
    one task sees it, and the rest is what they don't hold."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") > n).drop("_rk")
    return df.exceptAll(df.orderBy(*order).limit(n))


def arg_best(df: DataFrame, metric: str, name: str = "model", ordinal: str = "ordinal",
             higher_is_better: bool = True) -> DataFrame:
    """The row with the best ``metric``; ties go to the lowest ``ordinal``
    (first seen wins, as a strict-improvement scan)."""
    m = F.col(metric)
    order = F.struct((-m if higher_is_better else m).alias("k"), F.col(ordinal).alias("o"))
    return df.agg(F.min_by(F.struct(*df.columns), order).alias("_b")).select("_b.*")


def metric_matrix(long: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Long (row, column, value) metrics → one row per ``row`` with a column
    per metric; the pivot values are given, so no extra distinct pass."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value))


def rank_within_key(df: DataFrame, key: str, order: list[str], out: str = "rank",
                    hot_threshold: int = 1_000_000, chunk_rows: int | None = None,
                    sample_per_chunk: int = 16, seed: int = 7) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order)`` that survives a
    key holding a large share of all rows.

    One aggregate finds the keys (NULL is a key, too) with more than
    ``hot_threshold`` rows; there are fewer than rows / threshold. Without
    hot keys this is the plain window. Each hot key is cut into contiguous
    chunks of about ``chunk_rows`` at boundary tuples taken from a sample of
    its rows (about ``sample_per_chunk`` per chunk); the boundaries are
    literals, so a row's chunk (the number of boundaries ≤ its tuple) is a
    deterministic function of the row — the same in every branch and on
    recomputation after executor loss. Rows are numbered per (key, chunk)
    and shifted by the sizes of the earlier chunks of the same key; the
    offset table has one row per (key, chunk).
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_threshold).collect()
    if not hot:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    per_chunk = chunk_rows or max(hot_threshold // 2, 1)
    tup = F.struct(*[F.col(c) for c in order])
    chunk = F.lit(0)
    for r in hot:
        k, n = r[key], r["_n"]
        mine = F.col(key).eqNullSafe(F.lit(k).cast(df.schema[key].dataType))
        n_chunks = max(2, -(-n // per_chunk))
        frac, sample = min(1.0, sample_per_chunk * n_chunks / n), []
        while not sample:  # ≈ sample_per_chunk × n_chunks rows; an unlucky empty draw is repeated larger
            sample = sorted((tuple(x) for x in df.filter(mine).sample(fraction=frac, seed=seed)
                             .select(*order).collect()), key=_sort_key)
            frac = min(1.0, 2 * frac)
        bounds = [sample[int(i * len(sample) / n_chunks)] for i in range(1, n_chunks)]
        arr = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, b)])
                        for b in bounds])
        idx = F.size(F.filter(arr, lambda b: b <= tup))
        chunk = F.when(mine, idx).otherwise(chunk)
    chunked = df.withColumn("_chunk", chunk)
    local = chunked.withColumn("_lr", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order)))
    sizes = chunked.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_of")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_key", "_of", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (local.join(offs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of")))
            .withColumn(out, F.col("_lr") + F.col("_off"))
            .drop("_chunk", "_lr", "_off", "_key", "_of"))


def _sort_key(t: tuple):
    # NULLs first, as Spark's ascending order
    return tuple((v is not None, v) for v in t)
