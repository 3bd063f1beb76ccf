"""Exact selection equals numpy's linear-interpolation quantiles."""
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.operators import quantiles
from orderlens.operators.quantiles import global_quantiles, grouped_quantiles, order_code, order_number

values = st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False, width=32),
                            st.floats(), st.none()), min_size=1, max_size=120)
qs = st.lists(st.sampled_from([0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]), min_size=1, max_size=4, unique=True)


def plain(vals, q):
    present = np.array([v for v in vals if v is not None and np.isfinite(v)], dtype=float)
    return [None] * len(q) if present.size == 0 else np.percentile(present, [x * 100 for x in q], method="linear")


def same(got, want):
    return list(got) == list(want) if want[0] is None else np.allclose(np.array(got, float), want, rtol=1e-12, atol=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, q=qs)
def test_selection_matches_numpy(spark, vals, q):
    df = spark.createDataFrame([(v, v) for v in vals], "x double, y double").withColumn("y", F.lit(7.0))
    with np.errstate(over="ignore"):
        got = global_quantiles(df, ["x", "y"], q)
        assert same(got["x"], plain(vals, q)) and got["y"] == [7.0] * len(q)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(-20, 20).map(float))),
                     min_size=1, max_size=120))
def test_grouped_selection_matches_numpy(spark, vals):
    df = spark.createDataFrame(vals, "g int, x double")
    got = grouped_quantiles(df, ["g"], ["x"], [0.25, 0.5, 0.75], ["a", "b", "c"]).collect()
    assert sorted((r["g"] is not None, r["g"]) for r in got) == sorted({(g is not None, g) for g, _ in vals})
    for r in got:
        assert same(r[1:], plain([x for g, x in vals if g == r["g"]], [0.25, 0.5, 0.75]))


def test_codes_sort_as_their_numbers(spark):
    r = np.random.default_rng(1)
    bits = r.integers(0, 2**63, 4000, dtype=np.uint64)
    x = [v for v in bits.view(np.float64).tolist() if np.isfinite(v)]
    x += [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, 0.1, 1e15 + 0.3]
    x += [y for p in range(-1074, 1024, 7) for y in (2.0**p, np.nextafter(2.0**p, 0), np.nextafter(2.0**p, 9e307))]
    x += [-v for v in x]
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", order_code(F.col("x")).alias("c")) \
        .withColumn("y", order_number(F.col("c"))).collect()
    for v, c, y in rows:
        assert y == v
        plain_code = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert c == (-plain_code if v < 0 else plain_code), v


@pytest.mark.parametrize("groups, broadcast", [(1000, 10**6), (50, 0)])
def test_many_groups_skewed_constant_and_missing_columns(spark, monkeypatch, groups, broadcast):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast)
    r = np.random.default_rng(2)
    n = 20_000
    g = np.where(r.random(n) < 1 / 3, 0, r.integers(0, groups, n))  # a third of all rows in one group
    rows = [(int(a), float(b), 3.5, float("nan"), float(np.exp(c))) for a, b, c in zip(g, r.integers(0, 5, n), r.normal(size=n) * 20)]
    df = spark.createDataFrame(rows, "g int, few double, constant double, missing double, wide double").repartition(8)
    q = [0.1, 0.5, 0.99]
    got = grouped_quantiles(df, ["g"], ["few", "constant", "missing", "wide"], q).collect()
    assert len(got) == len(set(g.tolist()))
    table = np.array([x[1:] for x in rows])
    for row in got:
        mine = table[g == row["g"]]
        assert list(row[4:7]) == [3.5] * 3 and list(row[7:10]) == [None] * 3
        assert np.allclose(row[1:4], np.percentile(mine[:, 0], [10, 50, 99])) and np.allclose(row[10:13], np.percentile(mine[:, 3], [10, 50, 99]))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert grouped_quantiles(df, ["g"], ["x"], [0.5]).collect() == [] and global_quantiles(df, ["x"], [0.5]) == {"x": [None]}
