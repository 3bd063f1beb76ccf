"""Column expressions shared by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen;
none needs a Python UDF. Each encodes one pandas/numpy semantic that Spark
does not give by default (see the README's semantics table).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "day_diff", "weekday_mon0", "late_flag", "positive_target", "negative_target",
    "strict_binary_target", "clip", "finite_or_null", "nan_inf_to_zero", "log1p_nonneg",
    "score_bucket", "hash_bucket", "stars", "class_label", "yes_no", "not_equal_keep_null",
]

MICROS_PER_DAY = 86_400_000_000
HASH_FACTOR = 73_244_475  # odd, below 2^27


def seed_mask(seed: int) -> int:
    """32 bits that differ in many places for neighbouring seeds."""
    return (seed * 2_654_435_761 + 1_013_904_223) % (1 << 32)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(end, start) -> Column:
    """Whole days of elapsed time, floored (−2 h → −1), as double.

    Counts elapsed microseconds, not calendar dates (``datediff`` gives 1
    for a 2-hour span over midnight). NULL when either side is NULL.
    """
    us = F.timestamp_diff("MICROSECOND", col_(start), col_(end))
    return F.floor(us / F.lit(MICROS_PER_DAY)).cast("double")


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(col_(ts))


def late_flag(delay) -> Column:
    """``delay > 0`` where a missing delay counts as not late."""
    return F.coalesce(col_(delay) > 0, F.lit(False))


def positive_target(score) -> Column:
    """1 when score ≥ 4, else 0 (NULL → 0)."""
    return F.coalesce((col_(score) >= 4).cast("int"), F.lit(0))


def negative_target(score) -> Column:
    """1 when score ≤ 2, else 0 (NULL → 0)."""
    return F.coalesce((col_(score) <= 2).cast("int"), F.lit(0))


def strict_binary_target(score) -> Column:
    """1.0 when ≥ 4, 0.0 when ≤ 2, NULL otherwise (neutral or missing)."""
    c = col_(score)
    return F.when(c >= 4, F.lit(1.0)).when(c <= 2, F.lit(0.0)).otherwise(F.lit(None).cast("double"))


def clip(c, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (``greatest(NULL, x)`` would be x)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def finite_or_null(c) -> Column:
    """NaN and ±inf become NULL (Spark answers True to ``NaN > 0``)."""
    c = col_(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def nan_inf_to_zero(c) -> Column:
    """NaN / ±inf → 0.0, NULL kept."""
    c = col_(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def log1p_nonneg(c) -> Column:
    """``log1p(max(x, 0))`` with NULL kept."""
    c = col_(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def score_bucket(c, lo: int = 1, hi: int = 5) -> Column:
    """Round half-to-even, clamp to [lo, hi], integer (NULL kept)."""
    return clip(F.bround(col_(c), 0), float(lo), float(hi)).cast("int")


def hash_bucket(key, seed: int = 42, buckets: int = 100) -> Column:
    """Deterministic bucket of an integer key in [0, buckets).

    The seed is mixed in before two rounds of xor-shift and multiply modulo
    2^32, so that other seeds give unrelated buckets. Every step is a
    bijection of 32-bit numbers: different keys below 2^32 have different
    hashes. Products stay inside BIGINT, the form is portable to any SQL
    engine, and nothing depends on partitioning (unlike ``rand``).
    """
    x = F.pmod(col_(key).cast("bigint"), F.lit(1 << 32)).bitwiseXOR(F.lit(seed_mask(seed)))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(HASH_FACTOR)) % F.lit(1 << 32)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x % F.lit(buckets)


# Display symbols and class labels of a scored order.
FULL_STAR, EMPTY_STAR = "★", "☆"
CLASS_LABELS = {1: "Bom (1)", 0: "Ruim (0)"}


def stars(c, lo: int = 1, hi: int = 5) -> Column:
    """Filled stars for the rounded, clamped score, padded with empty stars to ``hi``."""
    n = score_bucket(c, lo, hi)
    return F.concat(F.repeat(F.lit(FULL_STAR), n), F.repeat(F.lit(EMPTY_STAR), F.lit(hi) - n))


def class_label(pred) -> Column:
    """Display label of a 0/1 class prediction (anything but 1 → the 0 label)."""
    return F.when(col_(pred) == 1, F.lit(CLASS_LABELS[1])).otherwise(F.lit(CLASS_LABELS[0]))


# Labels of the late-delivery flag.
YES_LABEL, NO_LABEL = "Sim", "Não"


def yes_no(flag, yes: str = YES_LABEL, no: str = NO_LABEL) -> Column:
    """Display label of a boolean flag (NULL → the 'no' label)."""
    return F.when(col_(flag), F.lit(yes)).otherwise(F.lit(no))


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` where NULL counts as different (rows kept)."""
    return ~col_(c).eqNullSafe(F.lit(value))
