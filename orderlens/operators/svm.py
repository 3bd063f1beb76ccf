"""Linear support vector machine with a certificate.

With cost C, row weights c and the vector x (a constant slot for the
intercept added, penalised with the rest), minimised is

    P(w) = |w|^2 / 2 + C * sum(c * max(0, 1 - y w.x)),  y = -1 or 1,

and maximised its dual, D(a) = sum(a) - |w(a)|^2 / 2 with 0 <= a <= C c and
w(a) = sum(a y x). D never exceeds P, so P - D bounds what is left to gain,
whatever way was taken to the point: the gap certifies the result.

Rows lie in blocks that never move. Where there is one, it climbs the dual
along its coordinates, one after the other in an order drawn for the round,
and goes the share of the way, at most the whole, at which D is largest; that
is known in closed form, so D never falls.

Where there are several, climbing each on its own would overshoot the more
the more there are. They take Newton steps instead: the hinge's corner is
rounded over a width h, which makes P smooth, and h shrinks once what is left
of the gap comes from the rounding. A round is one pass over the rows, of which
the sums at the new w (loss, gradient, second derivatives: some 2,000 numbers
for 60 slots) reach the driver. The slopes of the rounded hinge are dual
numbers within their bounds, so every pass has its own D, and the gap is that
of the hinge itself.

Defined results: without rows the model is zero and the gap 0; with one class
that class is predicted; rows with a null label or vector or a weight of
0 change nothing; equal rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_VALUES = 1 << 22  # numbers in a block, 32 MB
CODEC = "lz4"  # of a block's vectors where they are stored or sent: mostly zeros of one-hot slots
GROUP = 64  # rows whose products with each other are taken at once
STORED_EVERY = 10  # rounds after which the dual numbers are stored
ROUNDED = 4.0  # width over which the hinge's corner is rounded at first
HALVINGS = 8  # of a Newton step, tried in the pass that takes it


def climb(x: np.ndarray, y: np.ndarray, most: np.ndarray, a: np.ndarray, w: np.ndarray, spread: float, passes: int,
          draws: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Dual numbers of a block's rows after some passes over them, and what they add to w.

    The margins of ``GROUP`` rows are one product; a row's step changes those
    of the rest by the rows' products with each other."""
    a, step = a.copy(), np.zeros(len(w))
    for _ in range(passes):
        order = draws.permutation(len(y))
        for at in range(0, len(order), GROUP):
            some = order[at:at + GROUP]
            z = x[some] * y[some, None]
            left = 1.0 - z @ (w + spread * step)
            products = spread * (z @ z.T)
            old = a[some]
            new = old.copy()
            for i, (now, top, own) in enumerate(zip(old.tolist(), most[some].tolist(), products.diagonal().tolist())):
                to = min(top, max(0.0, now + left[i] / own)) if own else top
                if to != now:
                    left -= (to - now) * products[i]
                    new[i] = to
            a[some] = new
            step += (new - old) @ z
    return a, step


def packed(v: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(v).tobytes(), CODEC, asbytes=True)


def vectors(r: dict, rows: int) -> np.ndarray:
    """A block's vectors, one row each."""
    return np.frombuffer(pa.decompress(r["x"], r["bytes"], CODEC), float).reshape(rows, -1)


def _blocks(df: DataFrame, features: str, label: str, weight: str | None, scale: float, width: int) -> tuple[DataFrame, int]:
    """(block, x, bytes, y, c): stored blocks of rows as packed numbers (``x`` compressed, with its size), and how many there are."""
    rows = df.select(vector_to_array(features).alias("x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("c")
                     ).where(F.col("x").isNotNull() & F.col(label).isNotNull() & (F.col("c") > 0))
    rows = materialize(rows)
    in_block = max(GROUP, BLOCK_VALUES // width)
    n = max(1, -(-rows.count() // in_block))
    schema = pa.schema([("x", pa.binary()), ("bytes", pa.int64()), ("y", pa.binary()), ("c", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            x = np.concatenate([np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1) for b in held])
            x = np.concatenate([x, np.full((len(x), 1), scale)], axis=1)
            y, c = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((packed(x), x.nbytes, y.tobytes(), c.tobytes()), schema)], schema=schema)
    # dealt without a key, one block a partition
    blocks = rows.repartition(n).mapInArrow(pack, "x binary, bytes long, y binary, c binary")
    blocks = materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"))
    return blocks, blocks.count()


def _round(blocks: DataFrame, state: DataFrame | None, share: float, w: np.ndarray, cost: float, spread: float, passes: int,
           seed: int) -> DataFrame:
    """(block, a, b, step, loss, dual, more): dual numbers before and after, the step in w, the loss and dual sum before,
    and what the dual sum gains. The last round's went ``share`` of their way."""
    schema = pa.schema([("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("step", pa.list_(pa.float64())),
                        ("loss", pa.float64()), ("dual", pa.float64()), ("more", pa.float64())])
    rows = blocks if state is None else blocks.join(state.select("block", "a", "b"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y, c = (np.frombuffer(r[k], float) for k in ("y", "c"))
                x = vectors(r, len(y))
                a = np.zeros(len(y))
                if "a" in r:
                    before, after = (np.frombuffer(r[k], float) for k in ("a", "b"))
                    a = np.clip(before + share * (after - before), 0.0, cost * c)
                loss = cost * float(c @ np.maximum(0.0, 1.0 - y * (x @ w)))
                b, step = climb(x, y, cost * c, a, w, spread, passes, np.random.default_rng([seed, r["block"]]))
                values = (r["block"], a.tobytes(), b.tobytes(), step.tolist(), loss, float(a.sum()), float((b - a).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
    return rows.mapInArrow(run, "block long, a binary, b binary, step array<double>, loss double, dual double, more double")


def rounded(left: np.ndarray, h: float) -> np.ndarray:
    """The hinge with its corner rounded over (0, h): a parabola there, less by h / 2 beyond."""
    inside = np.clip(left, 0.0, h)
    return inside * inside / (2 * h) + np.maximum(left - h, 0.0)


def _pass(blocks: DataFrame, w: np.ndarray, step: np.ndarray, cost: float, h: float) -> dict:
    """Sums over all rows at w + step, and the rounded loss at w + step, w + step / 2, ..."""
    width = len(w)
    upper = np.triu_indices(width)
    sizes = {"halves": HALVINGS, "loss": 1, "dual": 1, "bent": 1, "slopes": width, "second": len(upper[0])}
    edges = np.concatenate(([0], np.cumsum([*sizes.values()])))
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(edges[-1])
        for batch in batches:
            for r in batch.to_pylist():
                y, c = (np.frombuffer(r[k], float) for k in ("y", "c"))
                x, c = vectors(r, len(y)), cost * c
                left, along = 1.0 - y * (x @ w), y * (x @ step)
                halves = [c @ rounded(left - along / 2 ** k, h) for k in range(HALVINGS)]
                left -= along
                a = c * np.clip(left / h, 0.0, 1.0)
                some = np.flatnonzero((left > 0) & (left < h))
                near = x[some]
                second = (near * (c[some] / h)[:, None]).T @ near
                total += np.concatenate((halves, [c @ np.maximum(0.0, left), a.sum(), float((a / c) @ a) * h / 2], (a * y) @ x, second[upper]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], schema.field(0).type)], schema=schema)
    sums = blocks.mapInArrow(run, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    total = np.zeros(edges[-1])
    for r in sums.collect():  # one number a pair of slots
        total[r["pos"]] = r["s"]
    out = {k: total[a:b] if b - a > 1 else float(total[a]) for k, a, b in zip(sizes, edges[:-1], edges[1:])}
    second = np.zeros((width, width))
    second[upper] = total[edges[-2]:]
    return out | {"second": second + np.triu(second, 1).T + np.eye(width), "slopes": total[edges[-3]:edges[-2]]}


def newton(blocks: DataFrame, width: int, cost: float, gap: float, rounds: int) -> tuple[np.ndarray, float, float, int]:
    """:func:`solve` over several blocks, a pass a round."""
    w, step, h = np.zeros(width), np.zeros(width), ROUNDED
    best, dual, done, limit = (np.inf, w), -np.inf, 0, np.inf  # the rounded objective may not rise over ``limit``
    for done in range(1, rounds + 1):
        sums, to = _pass(blocks, w, step, cost, h), w + step
        half, from_dual = float(to @ to) / 2, float(sums["slopes"] @ sums["slopes"]) / 2
        primal, lower = half + sums["loss"], sums["dual"] - from_dual
        if primal < best[0]:
            best = (primal, to)
        dual = max(dual, lower)
        if best[0] - dual <= gap * best[0]:
            break
        tried = [float((w + step / 2 ** k) @ (w + step / 2 ** k)) / 2 + v for k, v in enumerate(sums["halves"])]
        shorter = int(np.argmin(tried))
        if tried[0] > limit and shorter:
            step, limit = step / 2 ** shorter, np.inf
            continue
        w = to
        if tried[0] - (lower - sums["bent"]) < (primal - lower) / 2:  # the rounding is most of the gap
            h, step, limit = h / 4, np.zeros(width), np.inf
            continue
        slope = w - sums["slopes"]
        step = -np.linalg.solve(sums["second"], slope)
        limit = tried[0] + 1e-4 * float(slope @ step)
    return best[1], best[0], dual, done


def solve(df: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, cost: float = 1.0,
          intercept_scale: float = 1.0, gap: float = 1e-3, rounds: int = 60, passes: int = 30,
          seed: int = 42) -> tuple[np.ndarray, float, float, int]:
    """(w with the intercept's slot last, P(w), D, rounds taken).

    Stops when P - D <= ``gap`` * P, or after ``rounds``; of the points seen,
    the one with the smallest P is returned with the largest D."""
    df = df.where(F.col(features).isNotNull())
    first = df.select(F.size(vector_to_array(features)).alias("n")).head()
    width = (first["n"] if first else 0) + 1
    blocks, n = _blocks(df, features, label, weight, intercept_scale, width)
    if not n:
        return np.zeros(width), 0.0, 0.0, 0
    if n > 1:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        found = newton(blocks, width, cost, gap, rounds)
        blocks.unpersist()
        return found
    # by block number, so that a round brings the dual numbers to the rows, not the rows to them
    blocks = blocks.repartition(n, "block").persist(StorageLevel.MEMORY_AND_DISK)
    w, state, best, dual, done, share = np.zeros(width), None, (np.inf, np.zeros(width)), -np.inf, 0, 1.0
    for done in range(1, rounds + 1):
        ahead = _round(blocks, state, share, w, cost, 1.0, passes, seed + done)
        ahead = materialize(ahead) if done % STORED_EVERY == 0 else ahead.persist(StorageLevel.MEMORY_AND_DISK)
        sums = ahead.select(F.posexplode(F.concat("step", F.array("loss", "dual", "more")))).groupBy("pos").agg(F.sum("col").alias("s"))
        found = {r["pos"]: r["s"] for r in sums.collect()}  # one number a slot
        *step, loss, held, more = (found[k] for k in range(width + 3))
        half = float(w @ w) / 2
        if half + loss < best[0]:
            best = (half + loss, w)
        dual = max(dual, held - half)
        if state is not None:
            state.unpersist()
        state = ahead
        if best[0] - dual <= gap * best[0]:
            break
        step = np.array(step)
        square = float(step @ step)
        share = min(1.0, max(0.0, (more - float(w @ step)) / square)) if square else 1.0
        w = w + share * step
    state.unpersist()
    blocks.unpersist()
    return best[1], best[0], dual, done


class LinearSVMModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Signs of w.x + intercept, with the objective and the dual bound that the fit ended with."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "a weight for each slot", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "added to the weighted sum", TypeConverters.toFloat)
    objective = Param(Params._dummy(), "objective", "P(w)", TypeConverters.toFloat)
    bound = Param(Params._dummy(), "bound", "D, which no P falls below", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "rounds taken", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features")

    def gap(self) -> float:
        """The share of P(w) that a better w could win at most."""
        p = self.getOrDefault(self.objective)
        return (p - self.getOrDefault(self.bound)) / p if p else 0.0

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        w = F.array(*map(F.lit, self.getOrDefault(self.weights))) if self.getOrDefault(self.weights) else F.array().cast("array<double>")
        margin = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.getOrDefault(self.intercept))), lambda s, v: s + v)
        return df.withColumn("svm_margin", margin).withColumn("prediction", F.when(F.col("svm_margin") > 0, 1.0).otherwise(0.0))


class LinearSVM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """:func:`solve` as an estimator of labels 0 and 1."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weights of rows (empty: 1)", TypeConverters.toString)
    cost = Param(Params._dummy(), "cost", "C", TypeConverters.toFloat)
    interceptScale = Param(Params._dummy(), "interceptScale", "the constant slot; larger ones free the intercept", TypeConverters.toFloat)
    gapTol = Param(Params._dummy(), "gapTol", "relative gap to stop at", TypeConverters.toFloat)
    maxRounds = Param(Params._dummy(), "maxRounds", "rounds at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the order of rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="", cost=1.0, interceptScale=1.0, gapTol=1e-3,
                 maxRounds=60, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", cost=1.0, interceptScale=1.0, gapTol=1e-3,
                         maxRounds=60, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearSVMModel:
        get = self.getOrDefault
        w, p, d, rounds = solve(df, get(self.featuresCol), get(self.labelCol), get(self.weightCol) or None, get(self.cost),
                                get(self.interceptScale), get(self.gapTol), get(self.maxRounds), seed=get(self.seed))
        return LinearSVMModel()._set(featuresCol=get(self.featuresCol), weights=[float(v) for v in w[:-1]],
                                     intercept=float(w[-1]) * get(self.interceptScale), objective=float(p), bound=float(d), rounds=rounds)
