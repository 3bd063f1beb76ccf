"""Exact quantiles by radix selection.

A double has a 64-bit code that sorts as the number does. The value at a rank
is found digit by digit, 16 bits at a time: count the values of a (group,
column) by their next digit, take the digit inside which the rank falls, and
go on among the values that share all digits so far; a rank is found once the
values that are left are equal, after four digits at the latest. One count of
the rows for each digit serves every rank of every column and group together;
groups are a grouping column, so there may be any number of them, of any size,
and of them only the number of open prefixes reaches the driver. What is counted
is combined before it moves (65,536 digits for each group, column and open
prefix at most), a window adds up one group's digits. There is one path:
constant, skewed and continuous columns differ only in how many digits occur.

Interpolation matches ``percentile`` (linear between the values at ranks floor
and ceil of q * (n - 1)). NaN and infinities count as missing; -0.0 is 0.0;
a group without values has NULL quantiles. NULL group keys are a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite_or_null
from ..session import materialize

DIGIT = 16
PASSES = 64 // DIGIT
BROADCAST_ROWS = 100_000  # open prefixes, some 30 bytes and the group's key each


def order_code(x: Column) -> Column:
    """The long that sorts like a finite double: exponent and mantissa, negated for negative numbers.

    Scaling by a power of two is exact, so no bit is lost."""
    a = F.abs(x)
    power = F.floor(F.log2(a)).cast("int")  # off by one at most, next to powers of two
    power = F.when(a < F.pow(F.lit(2.0), power), power - 1).when(a >= F.pow(F.lit(2.0), power + 1), power + 1).otherwise(power)
    usual = (power + 1023).cast("long") * (1 << 52) + ((a / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("long")
    tiny = (a * 2.0 ** 537 * 2.0 ** 537).cast("long")  # subnormal numbers
    code = F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0 ** -1022, tiny).otherwise(usual)
    return F.when(x < 0, -code).otherwise(code)


def order_number(code: Column) -> Column:
    """The double that has this code."""
    a = F.abs(code)
    exponent, mantissa = F.shiftright(a, 52).cast("int"), a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    usual = (mantissa / float(1 << 52) + 1) * F.pow(F.lit(2.0), exponent - 1023)
    x = F.when(exponent == 0, mantissa * 2.0 ** -537 * 2.0 ** -537).otherwise(usual)
    return F.when(code < 0, -x).otherwise(x)


def _counted(rows: DataFrame, number: int, open_: DataFrame | None) -> DataFrame:
    """(_g, _c, _prefix, _next, _n, _lo, _hi): values by their next digit, and the codes between which they lie."""
    prefix = F.lit(0).cast("long") if number == 1 else F.shiftright("_code", 64 - DIGIT * (number - 1))
    out = rows.select("_g", "_c", "_code", prefix.alias("_prefix"), F.shiftright("_code", 64 - DIGIT * number).alias("_next"))
    if open_ is not None:
        out = out.join(open_, ["_g", "_c", "_prefix"], "left_semi")
    return out.groupBy("_g", "_c", "_prefix", "_next").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))


def quantile_ranks(totals: DataFrame, qs: list[float]) -> DataFrame:
    """(_g, _c, _j, _h, _k) from (_g, _c, _total): the one or two ranks between which each quantile lies."""
    h = [F.lit(float(q)) * (F.col("_total") - 1) for q in qs]
    wanted = F.explode(F.array_distinct(F.array(*(F.struct(F.lit(j).alias("j"), x.alias("h"), side(x).cast("long").alias("k"))
                                                  for j, x in enumerate(h) for side in (F.floor, F.ceil))))).alias("w")
    return totals.select("_g", "_c", wanted).select("_g", "_c", F.col("w.j").alias("_j"), F.col("w.h").alias("_h"), F.col("w.k").alias("_k"))


def values_at_ranks(rows: DataFrame, ranks: Callable[[DataFrame], DataFrame], folds: int | None = None) -> DataFrame:
    """(_g, _c, _j, _h, _k, _code) of ``rows`` (_g, _c, _code), for the ranks (_g, _c, _j, _h, _k) of (_g, _c, _total).

    With ``folds`` the groups of the rows are folds 0 .. folds - 1, and those of the result all rows outside
    one fold, and under the number ``folds`` all rows: counts are taken once for each fold and added up, so
    no row is counted for several results."""
    def outside(g: str, among: int) -> Column:
        return F.explode(F.filter(F.array(*map(F.lit, range(among))), lambda x: x != F.col(g)))

    found, state, open_ = [], None, None
    for number in range(1, PASSES + 1):
        counted = _counted(rows, number, open_)
        if folds is not None:
            counted = counted.withColumn("_g", outside("_g", folds + 1)).groupBy("_g", "_c", "_prefix", "_next").agg(
                F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        if state is None:
            counted = materialize(counted)  # read for the totals and for the digits
            state = ranks(counted.groupBy("_g", "_c").agg(F.sum("_n").alias("_total")))
            state = state.select("*", F.col("_k").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
        before = Window.partitionBy("_g", "_c", "_prefix").orderBy("_next")
        upto = counted.withColumn("_upto", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        inside = (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_n"))
        state = materialize(state.join(upto, ["_g", "_c", "_prefix"]).where(inside).select(
            "_g", "_c", "_j", "_h", "_k", F.col("_next").alias("_prefix"),
            (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_lo", "_hi"))
        # a digit whose values are all equal is done, whatever digits are left
        found.append(state.where("_lo = _hi").select("_g", "_c", "_j", "_h", "_k", F.col("_lo").alias("_code")))
        state = state.where("_lo < _hi").drop("_lo", "_hi")
        open_ = state.select("_g", "_c", "_prefix")
        if folds is not None:
            open_ = open_.withColumn("_g", outside("_g", folds))
        open_ = open_.distinct()
        many = open_.count()
        if not many:
            break
        if many <= BROADCAST_ROWS:  # else joined by exchanging both sides
            open_ = F.broadcast(open_)
    return reduce(DataFrame.unionByName, found)


def code_rows(df: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """(_g, _c, _code): the code of every column's value (null where missing), ``_c`` its number."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), finite_or_null(c).cast("double").alias("x"))
                                 for i, c in enumerate(columns)))).alias("v")
    return df.select(group.alias("_g"), values).select("_g", F.col("v.c").alias("_c"), order_code(F.col("v.x")).alias("_code"))


def grouped_quantiles(df: DataFrame, by: list[str], columns: list[str], qs, names: list[str] | None = None) -> DataFrame:
    """One row for each group: ``by`` and a column ``<column>__<name>`` for each column and quantile, stored."""
    qs = list(qs)
    names = names or [f"q{j}" for j in range(len(qs))]
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    rows = code_rows(df, group, columns)
    # codes are read by every pass: computed once, recomputable from lineage
    stored = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = stored.where(F.col("_code").isNotNull())
        found = values_at_ranks(rows, lambda totals: quantile_ranks(totals, qs)).groupBy("_g", "_c", "_j").agg(
            F.first("_h").alias("_h"), order_number(F.min("_code")).alias("_lo"), order_number(F.max("_code")).alias("_hi"))
        between = (F.ceil("_h") - F.col("_h")) * F.col("_lo") + (F.col("_h") - F.floor("_h")) * F.col("_hi")
        found = found.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between))

        def one(i, j):
            return F.max(F.when((F.col("_c") == i) & (F.col("_j") == j), F.col("_q"))).alias(f"{columns[i]}__{names[j]}")
        wide = found.groupBy("_g").agg(*(one(i, j) for i in range(len(columns)) for j in range(len(qs))))
        if by:
            # a group without any value has its row as well
            wide = stored.select("_g").distinct().join(wide, "_g", "left")
        return materialize(wide.select(*(F.col(f"_g.{b}").alias(b) for b in by), *(c for c in wide.columns if c != "_g")))
    finally:
        stored.unpersist()


def global_quantiles(df: DataFrame, columns: list[str], qs) -> dict[str, list]:
    """{column: [quantile for each q]} over the finite values (None without any): one row reaches the driver."""
    qs = list(qs)
    row = grouped_quantiles(df, [], columns, qs).first()
    return {c: [None if row is None else row[f"{c}__q{j}"] for j in range(len(qs))] for c in columns}
