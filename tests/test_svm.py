"""The linear SVM against plain coordinate ascent on small data."""
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from orderlens.operators import svm


def data(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [r.random(), r.random(), float(r.random() < 0.3), r.gauss(0, 1)]
        y = int(2 * x[0] - x[1] + x[2] + 0.3 * x[3] + r.gauss(0, 0.4) > 0.8)
        rows.append((x, y, r.choice([0.5, 1.0, 2.0])))
    return rows


SCHEMA = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType()),
                       T.StructField("weight", T.DoubleType())])


def frame(spark, rows):
    return spark.createDataFrame([(Vectors.dense(x), y, c) for x, y, c in rows], SCHEMA)


def plain(rows, cost, passes=3000):
    """The dual climbed a coordinate at a time until nothing moves: the largest D and its w."""
    x = np.array([[*r[0], 1.0] for r in rows])
    y = np.array([2.0 * r[1] - 1 for r in rows])
    top = cost * np.array([r[2] for r in rows])
    a, w = np.zeros(len(rows)), np.zeros(x.shape[1])
    for _ in range(passes):
        moved = 0.0
        for i in range(len(rows)):
            to = min(top[i], max(0.0, a[i] + (1 - y[i] * (x[i] @ w)) / (x[i] @ x[i])))
            w, moved, a[i] = w + (to - a[i]) * y[i] * x[i], max(moved, abs(to - a[i])), to
        if moved < 1e-7:
            break
    return a.sum() - w @ w / 2, w


@pytest.mark.parametrize("spread", [1.0, 3.0])
def test_groups_climb_as_single_rows_do(spread):
    rows = data(200)
    x = np.array([[*r[0], 1.0] for r in rows])
    y, top = np.array([2.0 * r[1] - 1 for r in rows]), np.array([r[2] for r in rows])
    start, w0 = top * 0.25, (top * 0.25 * y) @ x
    a, step = svm.climb(x, y, top, start, w0, spread, 2, np.random.default_rng(5))
    draws, b, v = np.random.default_rng(5), start.copy(), w0.copy()
    for _ in range(2):
        for i in draws.permutation(len(rows)):
            to = min(top[i], max(0.0, b[i] + (1 - y[i] * (x[i] @ v)) / (spread * (x[i] @ x[i]))))
            v, b[i] = v + spread * (to - b[i]) * y[i] * x[i], to
    assert np.allclose(a, b) and np.allclose(step, ((b - start) * y) @ x)
    assert (a >= 0).all() and (a <= top).all()


@pytest.mark.parametrize("blocks", [1, 4])
def test_gap_certifies_the_optimum(spark, monkeypatch, blocks):
    rows = data()
    monkeypatch.setattr(svm, "BLOCK_VALUES", 5 * len(rows) // blocks)
    tol = 1e-3 if blocks == 1 else 1e-2
    w, p, d, _ = svm.solve(frame(spark, rows), weight="weight", gap=tol, cost=0.5)
    best, _ = plain(rows, 0.5)
    margins = np.array([[*r[0], 1.0] for r in rows]) @ w * [2 * r[1] - 1 for r in rows]
    assert p == pytest.approx(w @ w / 2 + 0.5 * sum(r[2] * max(0.0, 1 - m) for r, m in zip(rows, margins)))
    assert d <= best * (1 + 1e-6) and best <= p * (1 + 1e-6) and p - d <= tol * p


def test_model(spark, tmp_path):
    rows = data()
    df = frame(spark, rows)
    model = svm.LinearSVM(weightCol="weight", maxRounds=5).fit(df)
    out = model.transform(df).collect()
    assert np.mean([r.prediction == r.label for r in out]) > 0.8
    assert all(r.prediction == float(r.svm_margin > 0) for r in out) and 0 <= model.gap() < 0.1
    model.write().overwrite().save(str(tmp_path / "m"))
    again = svm.LinearSVMModel.load(str(tmp_path / "m"))
    assert [r.svm_margin for r in again.transform(df).collect()] == [r.svm_margin for r in out]


def test_odd_inputs(spark):
    nothing = svm.LinearSVM(maxRounds=3).fit(frame(spark, []))
    assert nothing.gap() == 0 and nothing.getOrDefault(nothing.intercept) == 0
    for only in (0, 1):
        df = frame(spark, [(x, only, c) for x, _, c in data(50)])
        assert {r.prediction for r in svm.LinearSVM(maxRounds=3).fit(df).transform(df).collect()} == {float(only)}
    rows = data(100)
    a = svm.solve(frame(spark, rows), weight="weight", rounds=3)
    extra = frame(spark, [*rows, (rows[0][0], None, 1.0), (rows[1][0], 1 - rows[1][1], 0.0), (rows[2][0], 1 - rows[2][1], None)])
    b = svm.solve(extra, weight="weight", rounds=30, gap=1e-4)
    assert b[2] <= a[1] * (1 + 1e-9) and a[2] <= b[1] * (1 + 1e-9)


def test_many_blocks_reach_a_small_gap(spark, monkeypatch):
    rows = data(1200, 4)
    monkeypatch.setattr(svm, "BLOCK_VALUES", 5 * 100)
    w, p, d, done = svm.solve(frame(spark, rows), weight="weight", gap=1e-4, rounds=60)
    margins = np.array([[*r[0], 1.0] for r in rows]) @ w * [2 * r[1] - 1 for r in rows]
    assert p == pytest.approx(w @ w / 2 + sum(r[2] * max(0.0, 1 - m) for r, m in zip(rows, margins)))
    assert done < 60 and d <= p and p - d <= 1e-4 * p


def test_blocks_are_stored_without_their_zeros(spark):
    r = random.Random(3)
    rows = [([r.random()] + [float(k == i % 60) for k in range(60)], i % 2, 1.0) for i in range(500)]
    blocks, n = svm._blocks(frame(spark, rows), "features", "label", "weight", 1.0, 62)
    (one,) = blocks.collect()
    assert n == 1 and len(one.x) < one.bytes / 8
    x = svm.vectors(one.asDict(), 500)
    assert sorted(x.tolist()) == sorted([*v, 1.0] for v, _, _ in rows)
