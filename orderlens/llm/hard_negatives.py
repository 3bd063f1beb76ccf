"""Hard-negative mining: rotated one-bit codes with a residual interval.

A row's vector u (integers) is rotated, and the signs of the rotated vector are its code: a unit
vector b of components +-1/sqrt(d), stored with its alignment a = <Ru, b>. What the code leaves,
u - a R'b, is coded again by another rotation, ``levels`` times; the norm of the last residual e is
stored. An anchor's product with the coded part is a sum of popcounts: the rotated anchor is cut into
bit planes, and planes AND code counts which of its components count positive. So

    |<q, u> - estimate| <= |q| |e| + sum of a |R q - cut planes of R q|

holds for every pair by Cauchy-Schwarz (the code is a unit vector), without chance. A row whose
interval can't reach the best is dropped; the others get their exact integer product. Intervals that
lie inside the wanted range for certain give the bound: the n-th largest of their lower ends.

Rows are packed into blocks as they are read; the anchors (a stated query set) into blocks as well,
and every anchor block meets every row block once, ``group`` row blocks at a time. A group returns
the best few of each anchor, never its pairs. Anchors travel to every group, rows to every anchor block.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part, nor do those whose integer product with another could pass a long; vectors of different
lengths are not compared, and empty ones have products of 0. Rows with equal ids are rows of their
own, each an anchor, positive or negative. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import materialize

from .vectors import matrices

MARGIN = 1e-9  # share of |q| |u| for rounding in the estimates
BLOCK = {"block": pa.int64(), "dims": pa.int64(), "ids": pa.binary(), "labels": pa.binary(), "vectors": pa.binary(),
         "codes": pa.binary(), "align": pa.binary(), "left": pa.binary()}


def rotation(dims: int, level: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dims, level]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], room), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def encode(vectors: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, norm of what is left) of every row; codes by level, row and word."""
    n, d = vectors.shape
    rest = vectors.astype(np.float64)
    codes, align = np.zeros((levels, n, -(-d // 64)), np.uint64), np.zeros((levels, n))
    if d == 0:
        return codes, align, np.zeros(n)
    for level in range(levels):
        turn = rotation(d, level)
        y = rest @ turn.T
        bits = y > 0
        codes[level] = words_of(bits)
        align[level] = np.abs(y).sum(axis=1) / np.sqrt(d)
        rest = rest - (align[level][:, None] / np.sqrt(d)) * (np.where(bits, 1.0, -1.0) @ turn)
    return codes, align, np.linalg.norm(rest, axis=1)


class Query:
    """Anchors' vectors cut into bit planes for each level's rotation."""

    def __init__(self, vectors: np.ndarray, levels: int, planes: int):
        x = vectors.astype(np.float64)
        self.d, self.norm, self.level = x.shape[1], np.linalg.norm(x, axis=1), []
        for level in range(levels if self.d else 0):
            y = x @ rotation(self.d, level).T
            low, high = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
            step = np.maximum(high - low, 1e-300) / ((1 << planes) - 1)
            cut = np.clip(np.rint((y - low) / step), 0, (1 << planes) - 1).astype(np.int64)
            near = low + cut * step
            self.level.append((words_of((cut[None] >> np.arange(planes)[:, None, None]) & 1), low[:, 0], step[:, 0],
                               near.sum(axis=1), np.linalg.norm(y - near, axis=1)))

    def interval(self, some: slice, codes: np.ndarray, align: np.ndarray, left: np.ndarray,
                 norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) product of these anchors with every coded row."""
        estimate = np.zeros((some.stop - some.start, len(left)))
        error = np.outer(self.norm[some], left) + MARGIN * np.outer(self.norm[some], norm) + 1e-6
        for (planes, low, step, total, missed), code, a in zip(self.level, codes, align):
            # sum of the components that the code counts positive
            ones = low[some, None] * np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            for weight, plane in enumerate(planes):
                both = np.zeros(estimate.shape, dtype=np.int64)
                for w in range(code.shape[1]):
                    both += np.bitwise_count(plane[some, w, None] & code[:, w])
                ones += (step[some, None] * (1 << weight)) * both
            estimate += (2 * ones - total[some, None]) * (a / np.sqrt(self.d))
            error += np.outer(missed[some], a)
        return estimate - error, estimate + error


def _block(block: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, levels: int) -> list:
    """One block, its rows by label."""
    order = np.lexsort((ids, labels))
    codes, align, left = encode(vectors[order], levels)
    return [block, vectors.shape[1], *(np.ascontiguousarray(x).tobytes() for x in (
        ids[order], labels[order], vectors[order], codes, align, left))]


class Block:
    """A packed block again."""

    def __init__(self, row: dict, levels: int):
        d = row["dims"]
        self.number, self.dims = row["block"], d
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, d)
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(levels, n, -(-d // 64))
        self.align = np.frombuffer(row["align"]).reshape(levels, n)
        self.left = np.frombuffer(row["left"])
        self.norm = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.row = (self.number << 20) + np.arange(n)  # a number of its own for each row


def pack(rows: DataFrame, scale: int, levels: int, block_rows: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """The rows as coded blocks."""
    schema = pa.schema(list(BLOCK.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for table, x in matrices(batches, "embedding", scale, block_rows):
            ids, labels = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(_block(number, ids, labels, x, levels), schema.types)], schema=schema)
            number += 1
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                        F.col(embedding).alias("embedding"))
    return named.where("vec_id is not null and label is not null").mapInArrow(run, _ddl(schema))


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.int32(): "int"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _anchors(blocks: DataFrame, every: int, levels: int, per_block: int, spread: int, wanted: DataFrame | None) -> DataFrame:
    """(part, salt, dims, ids, labels, vectors, rows, ranges): the anchors in blocks, once for each salt.

    ``wanted`` has (anchor, scores): only those anchors, with the positives' scores."""
    schema = pa.schema([("dims", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("label", pa.int64()),
                        ("vector", pa.binary())])

    def single(table: pa.Table) -> pa.Table:
        b = Block(table.to_pylist()[0], levels)
        some = np.flatnonzero(b.ids % every == 0)
        return pa.table([pa.array([b.dims] * len(some), pa.int64()), b.row[some], b.ids[some], b.labels[some],
                         pa.array([v.tobytes() for v in b.vectors[some]], pa.binary())], schema=schema)
    found = blocks.groupBy("block").applyInArrow(single, _ddl(schema))
    if wanted is not None:
        found = found.join(wanted, "anchor")
    else:
        found = found.withColumn("scores", F.lit(None).cast("array<bigint>"))
    found = materialize(found)
    counts = found.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("long").alias("parts"))
    # a row for each length of vectors; equal lengths of any number of anchors are dealt by their row
    dealt = found.join(F.broadcast(counts), "dims").withColumn("part", F.pmod(F.xxhash64("anchor"), F.col("parts")))

    def packed(table: pa.Table) -> pa.Table:
        t = table.sort_by([("label", "ascending"), ("anchor", "ascending")])
        return pa.table({"part": t.column("part")[:1], "dims": t.column("dims")[:1],
                         "ids": [np.asarray(t.column("id")).tobytes()], "labels": [np.asarray(t.column("label")).tobytes()],
                         "vectors": [b"".join(t.column("vector").to_pylist())],
                         "rows": [np.asarray(t.column("anchor")).tobytes()],
                         "scores": pa.array([t.column("scores").to_pylist()], pa.list_(pa.list_(pa.int64())))})
    out = dealt.groupBy("dims", "part").applyInArrow(
        packed, "part long, dims long, ids binary, labels binary, vectors binary, rows binary, scores array<array<bigint>>")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))


BEST = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _meet(blocks: DataFrame, anchors: DataFrame, parts: int, spread: int, levels: int, planes: int, find, top: int) -> DataFrame:
    """The ``top`` best rows of every anchor and slot: ``find(query, anchors, block)`` gives those of one row block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return BEST.empty_table()
        a = left.to_pylist()[0]
        ids, labels, own = (np.frombuffer(a[c], np.int64) for c in ("ids", "labels", "rows"))
        vectors = np.frombuffer(a["vectors"], np.int32).reshape(len(ids), a["dims"])
        query = Query(vectors, levels, planes)
        found = [find(query, (ids, labels, own, vectors, a["scores"]), Block(r, levels)) for r in right.to_pylist()]
        at, slot, row, vec, score = (np.concatenate(x) for x in zip(*found))
        order, place = _ranked(at, slot, row, vec, score)
        keep = order[place < top]
        return pa.table([own[at[keep]], slot[keep].astype(np.int32), row[keep], vec[keep], score[keep]], schema=BEST)
    rows = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(spread))).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    best = anchors.groupBy("part", "salt", "dims").cogroup(rows.groupBy("part", "salt", "dims")).applyInArrow(run, _ddl(BEST))
    window = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def _ranked(at, slot, row, vec, score) -> tuple[np.ndarray, np.ndarray]:
    """Rows by anchor, slot, falling score, id and row, and their places from 0 in an anchor's slot."""
    order = np.lexsort((row, vec, -score, slot, at))
    key = np.stack([at[order], slot[order]])
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    return order, np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _best(low, high, possible, sure, top: int) -> np.ndarray:
    """Rows that can be among the ``top``: no more than so many lie above them for certain."""
    floor = low[sure]
    if len(floor) >= top:
        possible = possible & (high >= np.partition(floor, len(floor) - top)[len(floor) - top])
    return np.flatnonzero(possible)


def _products(vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int64) @ vector.astype(np.int64)


NOTHING = tuple(np.empty(0, np.int64) for _ in range(5))


def _gathered(out: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*out)) if out else NOTHING


def _positives(top: int, sub: int = 64):
    """Each anchor's rows of the same label with the largest products."""
    def find(query: Query, anchors, b: Block):
        ids, labels, own, vectors, _ = anchors
        out = []
        for value in np.intersect1d(labels, b.labels):
            a, r = (slice(int(np.searchsorted(x, value)), int(np.searchsorted(x, value, "right"))) for x in (labels, b.labels))
            for at in range(a.start, a.stop, sub):
                some = slice(at, min(at + sub, a.stop))
                low, high = query.interval(some, b.codes[:, r], b.align[:, r], b.left[r], b.norm[r])
                for i in range(some.start, some.stop):
                    other = b.row[r] != own[i]
                    near = r.start + _best(low[i - at], high[i - at], other, other, top)
                    score = _products(vectors[i], b.vectors[near])
                    keep = np.lexsort((b.row[near], b.ids[near], -score))[:top]
                    out.append((np.full(len(keep), i), np.zeros(len(keep), np.int64), b.row[near][keep], b.ids[near][keep], score[keep]))
        return _gathered(out)
    return find


def _negatives(top: int, least: int, most: int, sub: int = 64):
    """For each anchor and positive, rows of other labels with ``least`` to ``most`` percent of its score."""
    def find(query: Query, anchors, b: Block):
        ids, labels, own, vectors, scores = anchors
        out = []
        for at in range(0, len(ids), sub):
            some = slice(at, min(at + sub, len(ids)))
            lows, highs = query.interval(some, b.codes, b.align, b.left, b.norm)
            for i in range(some.start, some.stop):
                low, high, other = lows[i - at], highs[i - at], b.labels != labels[i]
                for slot, score in enumerate(scores[i]):
                    a, z = -(-least * score // 100), most * score // 100  # whole products from a to z
                    if a > z:
                        continue
                    near = _best(low, high, other & (high >= a) & (low <= z), other & (low >= a) & (high <= z), top)
                    got = _products(vectors[i], b.vectors[near])
                    near, got = near[(got >= a) & (got <= z)], got[(got >= a) & (got <= z)]
                    keep = np.lexsort((b.row[near], b.ids[near], -got))[:top]
                    out.append((np.full(len(keep), i), np.full(len(keep), slot), b.row[near][keep], b.ids[near][keep], got[keep]))
        return _gathered(out)
    return find


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         scale: int = 256, levels: int = 6, planes: int = 6, block_rows: int = 4096, per_block: int = 4096, group: int = 8,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows
    whose id is divisible by ``every``: the best negatives for each of the best positives."""
    blocks = materialize(pack(rows, scale, levels, block_rows, vec_id, embedding, label))
    many = blocks.count()
    spread = max(1, -(-many // group))  # so many groups of row blocks

    def meet(find, top, wanted=None):
        anchors = materialize(_anchors(blocks, every, levels, per_block, spread, wanted))
        parts = (anchors.agg(F.max("part")).head()[0] or 0) + 1
        return materialize(_meet(blocks, anchors, parts, spread, levels, planes, find, top))
    near = meet(_positives(positives), positives)
    slots = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = slots.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))),
                                                     lambda s: s["positive_score"]).alias("scores"))
    far = meet(_negatives(negatives, least, most), negatives, scores)
    named = anchors_of(blocks, every, levels)
    return (far.join(slots, ["anchor", "slot"]).join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def anchors_of(blocks: DataFrame, every: int, levels: int) -> DataFrame:
    """(anchor, anchor_id): the row numbers and ids of the anchors."""
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        b = table.to_pylist()[0]
        ids = np.frombuffer(b["ids"], np.int64)
        some = np.flatnonzero(ids % every == 0)
        return pa.table([(b["block"] << 20) + some, ids[some]], schema=schema)
    return blocks.select("block", "ids").groupBy("block").applyInArrow(run, _ddl(schema))
