"""Bootstrap draws, hexagons and densities."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.functions import hash_bucket
from orderlens.operators import features, profile


@pytest.mark.parametrize("mean", [0.3, 1.0, 7.5, 64.0, 900.0])
def test_poisson_draws_have_their_distribution(spark, mean):
    rows = spark.range(1).select(F.lit(float(mean)).alias("_mean"))
    n = 40_000
    rep = profile._replicates(rows, lambda b: b.cast("long") * 7_919 + 11, n, 5)
    got = np.array([r[0] for r in profile._with_poisson(rep, rows).select("_w").collect()])
    assert len(got) == n and abs(got.mean() - mean) < 5 * math.sqrt(mean / n) and abs(got.var() / mean - 1) < 0.05
    if mean <= 8:
        for k in range(12):
            p = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
            assert abs((got == k).mean() - p) < 5 * math.sqrt(p / n) + 1e-4


def test_bags_match_normal_theory_without_explosion(spark):
    r = np.random.default_rng(1)
    x = r.lognormal(size=20_000)
    df = spark.createDataFrame([(i, i % 2 == 0, float(v)) for i, v in enumerate(x)] + [(99_999, None, None)], "id long, g boolean, v double")
    rows = {c["g"]: c for c in profile.mean_ci_bags(df, "v", ["g"], "id").collect()}
    assert set(rows) == {True, False}
    for even, row in rows.items():
        own = x[::2] if even else x[1::2]
        half = 1.96 * own.std() / math.sqrt(len(own))
        assert row["n"] == len(own) and math.isclose(row["mean"], own.mean())
        assert abs((row["ci_high"] - row["ci_low"]) / 2 / half - 1) < 0.35 and row["ci_low"] < row["mean"] + half and row["ci_high"] > row["mean"] - half


def test_points_belong_to_their_nearest_hexagon(spark):
    r = np.random.default_rng(2)
    points = r.normal(size=(500, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None, 1.0), (1.0, None)], "x double, y double")
    got = {(round(h["x"], 6), round(h["y"], 6)): h["n"] for h in features.hexagons(df, "x", "y", gridsize=12).collect()}
    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
    wide, high = (x1 - x0) / 12, (y1 - y0) / 6
    centres = [(x0 + (i + s) * wide, y0 + (j + s) * high) for s in (0, 0.5) for i in range(-1, 14) for j in range(-1, 8)]
    want: dict = {}
    for x, y in points:
        near = min(centres, key=lambda c: ((x - c[0]) / wide) ** 2 + 3 * ((y - c[1]) / high) ** 2)
        at = (round(near[0], 6), round(near[1], 6))
        want[at] = want.get(at, 0) + 1
    assert got == want
    assert features.hexagons(df.where("x > 1e9"), "x", "y").collect() == []
    one = features.hexagons(spark.createDataFrame([(2.0, 3.0)] * 4, "x double, y double"), "x", "y").collect()
    assert len(one) == 1 and one[0]["n"] == 4 and abs(one[0]["x"] - 2.0) < 0.1 and abs(one[0]["y"] - 3.0) < 0.1


def test_density_is_that_of_a_gaussian_kernel(spark):
    r = np.random.default_rng(3)
    x = np.clip(r.normal(3, 0.6, 4000), 1, 5)
    df = spark.createDataFrame([(4.0, float(v)) for v in x] + [(2.0, 2.5)] * 3 + [(None, 1.0)], "label double, prediction double")
    rows = sorted((d["y_true_bucket"], d["point"], d["x"], d["density"]) for d in features.pred_density(df).collect())
    assert [d for d in rows if d[0] == 2] == [(2, 0, 2.5, None)]
    mine = [d for d in rows if d[0] == 4]
    h = x.std(ddof=1) * len(x) ** -0.2
    assert len(mine) == 101
    for _, _, at, density in mine[::10]:
        exact = np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert abs(density - exact) < 2e-3
    counts = features.pred_histogram(df).collect()
    assert sum(c["n"] for c in counts if c["y_true_bucket"] == 4) == 4000 and all(c["bin_left"] < c["bin_right"] for c in counts)


def test_a_review_counts_for_each_row_of_its_customer(spark):
    from orderlens.operators import drivers
    reviews = spark.createDataFrame([(1, 10, 1), (2, 11, 5), (3, 12, 5)], "review_id long, order_id long, review_score long")
    orders = spark.createDataFrame([(10, 7), (11, 8)], "order_id long, customer_id long")
    customers = spark.createDataFrame([(7, "a"), (7, "b"), (9, "c")], "customer_id long, customer_state string")
    row = drivers.overall_bad_rate_states(reviews, orders, customers).first()
    assert row["n_rows"] == 4 and row["pct_bad"] == 50.0


def test_bags_read_their_rows_once(spark):
    """What is upstream runs once, whatever the number of groups, null ones too; bags and draws stay as their hashes say."""
    r = np.random.default_rng(4)
    rows = [(i, [None, "a", "b"][i % 3], float(v)) for i, v in enumerate(r.lognormal(size=600))] + [(7, "a", None), (None, "b", 1.0), (8, "none", None)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.createDataFrame(rows, "id long, g string, v double").mapInArrow(counted, "id long, g string, v double")
    got = {c["g"]: c for c in profile.mean_ci_bags(df, "v", ["g"], "id", bags=2, n_boot=5).collect()}
    assert seen.value == len(rows)

    assert set(got) == {None, "a", "b"}
    for g, row in got.items():
        own = [(i, v) for i, h, v in rows if h == g and v is not None]
        assert row["n"] == len(own) and math.isclose(row["mean"], sum(v for _, v in own) / len(own))
    keys = spark.createDataFrame([(i, v) for i, h, v in rows if h == "a" and v is not None], "id long, v double")
    lows = []
    for bag in range(2):
        taken = keys.where(hash_bucket("id", 142 + bag, 1 << 32) < 200 ** -0.4 * 2 ** 32).select(hash_bucket("id", 49, 1 << 32), "v").collect()
        mean, means = 200 / len(taken), []
        steps = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(201)])
        draws = spark.createDataFrame([(b, i, k + bag * 1_000_003 + b * 7_919) for b in range(5) for i, (k, _) in enumerate(taken)],
                                      "b int, i int, k long").select("b", "i", hash_bucket("k", 42, 1 << 32).alias("h")).collect()
        drawn = {(d["b"], d["i"]): int((steps <= (d["h"] + 0.5) / 2 ** 32).sum()) for d in draws}
        for b in range(5):
            w = [drawn[b, i] for i in range(len(taken))]
            means.append(sum(x * v for x, (_, v) in zip(w, taken)) / sum(w))
        lows.append(np.quantile(means, 0.025))
    assert math.isclose(got["a"]["ci_low"], np.mean(lows), rel_tol=1e-9)
