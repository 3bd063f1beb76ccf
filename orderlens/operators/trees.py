"""Tree ensembles grown level by level from node histograms.

Rows lie in blocks of binned features. Each task sums what its rows add to
every (node, feature, bin) counter, and the best splits are taken where the
counters meet. A tree is a table of nodes, and a model of ``trees`` trees has at
most ``trees * 2**(depth + 1)`` rows, whatever the data. Numbers are cut at
exact quantiles (at most ``bins``), a slot of a one-hot column is present or
not.

Boosting grows one tree after the other, a level at a time and a job a level.
A tree's first job also adds the tree before it to the rows' margins and keeps
them, so that no job goes through more trees than its own.

A forest's trees grow at once. While a node has more than ``SMALL_ROWS`` rows, a
level of all such nodes is one job that sends counters. The rows of smaller
nodes are few enough to be sent themselves, once: nodes of a tree with that many
rows together grow to the end in one task. What is on its way at a time is
bounded by the number of trees (``ON_THE_WAY`` rows).

Boosting is of second order: with gradient and hessian sums G and H of the
logistic loss, a leaf's weight is -G / (H + l2), a split gains
G_l^2/(H_l + l2) + G_r^2/(H_r + l2) - G^2/(H + l2), and no child has a hessian
sum below ``min_child_weight``. A forest's split is the one that lowers Gini
impurity most among a random few slots of the node; a row's weight in a tree is
a Poisson(1) draw. All draws are hashes of (row key, tree, seed): a lost
executor's rows draw the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, materialize
from .quantiles import global_quantiles

BLOCK_ROWS, MOST_ROWS = 50_000, 500_000  # of a block, while there are few and once there are many
SHARES = 8  # of a forest's trees, for each block of rows
SMALL_ROWS = 1 << 22  # of a forest's node that grows in one task
ON_THE_WAY = 1 << 28  # rows sent for the trees that grow at once, some 16 bytes each
ONE_TASK_ROWS = 1 << 20  # on which boosting runs in one task while many models are fitted
NODES_AT_ONCE, ROWS_AT_ONCE = 4096, 1 << 17  # of a level, whose counters are held at once
STORED_EVERY = 25  # rounds after which the rows' margins are stored
EPSILON = 1e-9
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def draw(keys: np.ndarray, *of: int) -> np.ndarray:
    """A number in [0, 1) for each key, another one for other ``of``."""
    salt = U64(0)
    with np.errstate(over="ignore"):
        for n in of:
            salt = mix(np.array([salt + U64(n % 2**64) + U64(0x9E3779B97F4A7C15)]))[0]
        return (mix(keys + salt) >> U64(11)) * 2.0 ** -53


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 18)))))


def poisson(keys: np.ndarray, *of: int) -> np.ndarray:
    """Poisson(1) draws by the inverse of their distribution."""
    return np.searchsorted(_POISSON, draw(keys, *of), "right").astype(np.float64)


# ---------------------------------------------------------------- binned rows
@dataclass
class Layout:
    """Slots of the feature vector: the cuts of each (a one-hot slot has the one cut 0.5) and their counters."""

    cuts: list[np.ndarray]
    offsets: np.ndarray = field(init=False)

    def __post_init__(self):
        sizes = np.array([len(c) + 1 for c in self.cuts], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.size = int(self.offsets[-1])
        self.slot = np.repeat(np.arange(len(sizes)), sizes)  # of each counter
        last = np.zeros(self.size, dtype=bool)
        last[self.offsets[1:] - 1] = True
        self.splits = np.flatnonzero(~last)  # counters after which a split can be
        self.sparse = np.array([len(c) == 1 and c[0] == 0.5 for c in self.cuts], dtype=bool)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for k, cut in enumerate(self.cuts):
            out[:, k] = np.searchsorted(cut, x[:, k], "left")
        return out


@dataclass
class Block:
    """Binned rows, the numbers that they are fitted on, and the margins of what is fitted already."""

    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    fold: np.ndarray
    margin: np.ndarray | None = None
    hot: np.ndarray | None = None  # the one-hot slots present in each row, -1 where there are fewer

    def rows(self, some: np.ndarray) -> Block:
        return Block(self.codes[some], self.y[some], self.w[some], self.key[some], self.fold[some], hot=None if self.hot is None else self.hot[some])

    def columns(self) -> np.ndarray:
        """All slots' codes, slot after slot."""
        return np.ascontiguousarray(self.codes.T)

    def ends(self, tree: Tree) -> np.ndarray:
        """The tree's node in which each row ends."""
        return tree.nodes(self.codes)

    def present(self, layout: Layout) -> np.ndarray:
        """``hot``, found once."""
        if self.hot is None:
            slots = np.flatnonzero(layout.sparse)
            row, k = np.nonzero(self.codes[:, slots])
            many = np.bincount(row, minlength=len(self.y))
            self.hot = np.full((len(many), int(many.max(initial=0))), -1, np.min_scalar_type(-max(1, len(layout.cuts))))
            self.hot[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = slots[k]
        return self.hot


def layout_of(df: DataFrame, features: str = "features", bins: int = 32) -> Layout:
    """Cuts at exact quantiles for slots of numbers; one-hot slots are told by the column's attributes."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    attrs = [a for group in meta.get("attrs", {}).values() for a in group]
    binary = {a["idx"] for a in meta.get("attrs", {}).get("binary", [])} | {a["idx"] for a in attrs if "__oh_" in a.get("name", "")}
    if "num_attrs" in meta or attrs:
        size = meta.get("num_attrs", len(attrs))
    else:
        first = df.select(F.size(vector_to_array(features)).alias("n")).head()
        size = first["n"] if first else 0
    numbers = [i for i in range(size) if i not in binary]
    x = vector_to_array(F.col(features))
    at = [k / bins for k in range(1, bins)]
    found = global_quantiles(df.select(*(x[i].alias(f"x{i}") for i in numbers)), [f"x{i}" for i in numbers], at) if numbers else {}
    cuts = [np.array([0.5]) if i in binary else np.unique([q for q in found[f"x{i}"] if q is not None]) for i in range(size)]
    return Layout(cuts)


PACKED = pa.schema([(c, pa.binary()) for c in ("codes", "y", "w", "key", "fold")])
PACKED_DDL = "codes binary, y binary, w binary, key binary, fold binary"


def pack(df: DataFrame, layout: Layout, features: str, label: str, weight: str | None, key: str | None, fold: str | None = None) -> DataFrame:
    """Binned rows, a batch of them in each row of the result."""
    keyed = F.xxhash64(F.col(key)) if key and key in df.columns else F.xxhash64(F.col(features).cast("string"), F.col(label))
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), keyed.alias("key"),
                     (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                parts = [layout.codes(x), *(np.asarray(b.column(i)) for i in range(1, 5))]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], schema=PACKED)
    return rows.mapInArrow(run, PACKED_DDL)


def unpack(rows: list[dict], width: int) -> Block:
    """The binned rows of packed ones."""
    held = [[np.frombuffer(r[c], t) for c, t in zip(PACKED.names, (np.uint8, float, float, np.int64, np.int32))] for r in rows]
    codes, y, w, key, fold = (np.concatenate(c) for c in zip(*held))
    return Block(codes.reshape(-1, width), y, w, key.view(np.uint64), fold)


def blocks_of(df: DataFrame, layout: Layout, features: str, label: str, weight: str | None, key: str | None, fold: str | None = None):
    """The rows as an RDD of :class:`Block`, stored in the shared folder."""
    df = materialize(df)
    rows = df.count()
    # once there are two blocks for every core, blocks grow before their number does
    parts = max(1, min(-(-rows // BLOCK_ROWS), max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // MOST_ROWS))))
    stored = materialize(pack(df.repartition(parts), layout, features, label, weight, key, fold))
    width = len(layout.cuts)

    def one(found) -> Iterator[Block]:
        rows = [r.asDict() for r in found]
        if rows:
            block = unpack(rows, width)
            block.present(layout)
            yield block
    return stored.rdd.mapPartitions(one).persist(StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------- trees as tables of nodes
@dataclass
class Tree:
    """Node 0 is the root; a leaf's slot is -1. A row with a code up to ``cut`` goes left."""

    slot: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def stump(cls) -> Tree:
        return cls(*(np.full(1, v, t) for v, t in ((-1, np.int32), (0, np.int32), (0, np.int32), (0, np.int32), (0.0, float), (0.0, float))))

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(codes), dtype=np.int32)
        going = np.arange(len(codes)) if self.slot[0] >= 0 else np.empty(0, np.int64)
        while len(going):
            here = at[going]
            to = np.where(codes[going, self.slot[here]] <= self.cut[here], self.left[here], self.right[here])
            at[going] = to
            going = going[self.slot[to] >= 0]
        return at

    def step(self, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The node after ``at`` on each row's way, for codes that lie slot after slot; a leaf's rows stay."""
        inner, nodes = self.slot >= 0, np.arange(len(self.slot))
        slot, cut = np.where(inner, self.slot, 0) * np.int64(columns.shape[1]), np.where(inner, self.cut, 255).astype(np.uint8)
        to = np.stack([np.where(inner, self.left, nodes), np.where(inner, self.right, nodes)], axis=1).ravel()
        right = columns.ravel().take(slot.take(at) + np.arange(len(at))) > cut.take(at)
        return to.take(2 * at + right)

    def ends(self, columns: np.ndarray) -> np.ndarray:
        """:meth:`nodes` for codes that lie slot after slot."""
        at, level = np.zeros(columns.shape[1], dtype=np.int64), np.zeros(1, dtype=np.int64)
        while (self.slot[level] >= 0).any():
            at = self.step(columns, at)
            level = level[self.slot[level] >= 0]
            level = np.concatenate([self.left[level], self.right[level]])
        return at

    def split(self, node: np.ndarray, slot: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Split nodes; the new nodes, left and right in turn, get these values."""
        n, k = len(self.slot), len(node)
        new = n + np.arange(2 * k)
        self.slot[node], self.cut[node], self.gain[node] = slot, cut, gain
        self.left[node], self.right[node] = new[::2], new[1::2]
        both = np.empty(2 * k)
        both[::2], both[1::2] = left, right
        more = Tree(*(np.full(2 * k, v, t) for v, t in ((-1, np.int32), (0, np.int32), (0, np.int32), (0, np.int32), (0.0, float), (0.0, float))))
        more.value = both
        for name in ("slot", "cut", "left", "right", "value", "gain"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        return new


def histogram(number: list[np.ndarray], hot: np.ndarray, layout: Layout, node: np.ndarray, count: int, channels: list[np.ndarray]) -> np.ndarray:
    """Sums of the channels by (node, counter); rows with node ``count`` take no part. The last counter has all of a node's rows.

    ``number`` has the codes of each slot of numbers, ``hot`` the one-hot slots present in each row (the vector's width: fewer)."""
    width, slots, sizes = len(layout.cuts) + 1, np.flatnonzero(~layout.sparse), np.diff(layout.offsets)
    out = np.zeros((len(channels), count, layout.size + 1))
    wide = int(sizes[slots].max(initial=1))
    base = node * wide
    for slot, code in zip(slots.tolist(), number):
        at, place = slice(layout.offsets[slot], layout.offsets[slot + 1]), base + code
        for c, v in enumerate(channels):
            out[c, :, at] = np.bincount(place, v, (count + 1) * wide).reshape(-1, wide)[:count, :sizes[slot]]
    place = ((node * width)[:, None] + hot).ravel()
    present = layout.offsets[:-1][layout.sparse] + 1
    for c, v in enumerate(channels):
        out[c][:, present] = np.bincount(place, np.repeat(v, hot.shape[1]), (count + 1) * width).reshape(-1, width)[:count, :-1][:, layout.sparse]
        out[c, :, -1] = np.bincount(node, v, count + 1)[:count]
    out[:, :, present - 1] = out[:, :, -1:] - out[:, :, present]
    return out


def best_splits(sums: np.ndarray, layout: Layout, gain: Callable, allowed: np.ndarray | None = None):
    """(gain, counter, left sums, right sums) of each node's best split; the first of equal ones, -inf where there is none."""
    total = sums[:, :, -1]
    run = np.cumsum(sums[:, :, :-1], axis=2)
    start = run[:, :, layout.offsets[layout.slot[layout.splits]]] - sums[:, :, layout.offsets[layout.slot[layout.splits]]]
    left = run[:, :, layout.splits] - start
    right = total[:, :, None] - left
    value = gain(left, right, total[:, :, None])
    if allowed is not None:
        value = np.where(allowed[:, layout.slot[layout.splits]], value, -np.inf)
    if not value.shape[1]:
        none = np.zeros(len(total[0]), dtype=np.int64)
        return np.full(len(none), -np.inf), none, total, total
    best = value.argmax(axis=1)
    node = np.arange(len(best))
    return value[node, best], layout.splits[best], left[:, node, best], right[:, node, best]


def grow_level(tree: Tree, open_: np.ndarray, found, layout: Layout, leaf: Callable) -> np.ndarray:
    """Split the open nodes by their best splits; the new nodes."""
    gain, counter, left, right = found
    some = np.flatnonzero(gain > EPSILON)
    slot = layout.slot[counter[some]]
    return tree.split(open_[some], slot, counter[some] - layout.offsets[slot], gain[some], leaf(left[:, some]), leaf(right[:, some]))


# ---------------------------------------------------------------- boosting
@dataclass(frozen=True)
class Boost:
    rounds: int = 300
    rate: float = 0.1
    depth: int = 6
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 1.0
    l2: float = 1.0
    positive_weight: float = 1.0
    seed: int = 42

    def gain(self, left, right, total):
        (gl, hl), (gr, hr), (g, h) = left, right, total
        with np.errstate(divide="ignore", invalid="ignore"):
            value = gl * gl / (hl + self.l2) + gr * gr / (hr + self.l2) - g * g / (h + self.l2)
        least = max(self.min_child_weight, EPSILON)
        return np.where((hl >= least) & (hr >= least), value, -np.inf)

    def leaf(self, sums):
        return -self.rate * sums[0] / (sums[1] + self.l2)

    def columns(self, number: int, width: int) -> np.ndarray:
        """The slots that this round's tree may use."""
        n = max(1, int(round(self.colsample * width)))
        allowed = np.zeros((1, width), dtype=bool)
        allowed[0, np.argsort(draw(np.arange(width, dtype=np.uint64), self.seed, number, 1), kind="stable")[:n]] = True
        return allowed


@dataclass
class Lean:
    """A block's rows as boosting reads them: codes of numbers slot after slot, one-hot slots present (the vector's width: fewer)."""

    number: np.ndarray
    hot: np.ndarray
    y: np.ndarray
    w: np.ndarray | None  # None: all 1
    key: np.ndarray
    sparse: np.ndarray  # of each slot, whether it is a one-hot one
    margin: np.ndarray | None = None

    @classmethod
    def of(cls, block: Block, layout: Layout) -> Lean:
        hot = block.present(layout)
        small = block.y.astype(np.uint8)
        return cls(np.ascontiguousarray(block.codes[:, ~layout.sparse].T), np.where(hot < 0, len(layout.cuts), hot).astype(hot_type(layout)),
                   small if (small == block.y).all() else block.y, None if (block.w == 1).all() else block.w, block.key, layout.sparse, block.margin)

    def rows(self, some: np.ndarray) -> Lean:
        return replace(self, number=self.number[:, some], hot=self.hot[some], y=self.y[some], w=None if self.w is None else self.w[some],
                       key=self.key[some], margin=None if self.margin is None else self.margin[some])

    @classmethod
    def joined(cls, parts: list[Lean]) -> Lean:
        """Rows without margins."""
        wide, none = max(p.hot.shape[1] for p in parts), len(parts[0].sparse)
        hot = [np.pad(p.hot, ((0, 0), (0, wide - p.hot.shape[1])), constant_values=none) for p in parts]
        w = None if all(p.w is None for p in parts) else np.concatenate([np.ones(len(p.y)) if p.w is None else p.w for p in parts])
        return cls(np.concatenate([p.number for p in parts], axis=1), np.concatenate(hot), np.concatenate([p.y for p in parts]), w,
                   np.concatenate([p.key for p in parts]), parts[0].sparse)

    def columns(self) -> np.ndarray:
        """All slots' codes, slot after slot."""
        n = len(self.y)
        out = np.zeros((len(self.sparse) + 1, n), dtype=np.uint8)
        out[:-1][~self.sparse] = self.number
        row = np.arange(n)
        for hot in self.hot.T:
            out.ravel()[hot * np.int64(n) + row] = 1
        return out[:-1]

    def ends(self, tree: Tree) -> np.ndarray:
        return tree.ends(self.columns())

    def channels(self, how: Boost, margin: np.ndarray) -> list[np.ndarray]:
        """Gradients and hessians of the rows."""
        p = 1 / (1 + np.exp(-margin))
        w = (1.0 if self.w is None else self.w) * np.where(self.y == 1, how.positive_weight, 1.0)
        return [(p - self.y) * w, p * (1 - p) * w]


def boost_sums(block: Lean, layout: Layout, how: Boost, number: int, margin: np.ndarray, tree: Tree, open_: np.ndarray) -> np.ndarray:
    """What a block adds to the open nodes' sums of gradients and hessians."""
    node = np.full(len(tree.slot), len(open_), dtype=np.int64)
    node[open_] = np.arange(len(open_))
    at = node.take(block.ends(tree))
    inside = at < len(open_)
    if how.subsample < 1:
        inside &= draw(block.key, how.seed, number, 0) < how.subsample
    own = np.flatnonzero(inside)
    channels = block.channels(how, margin)
    return histogram([c.take(own) for c in block.number], block.hot.take(own, axis=0), layout, at.take(own), len(open_), [v.take(own) for v in channels])


def boost_rounds(layout: Layout, how: Boost, start: float, sums: Callable) -> list[Tree]:
    """The trees, given ``sums(trees, tree, open nodes)`` over all rows."""
    trees: list[Tree] = []
    for number in range(how.rounds):
        tree, open_ = Tree.stump(), np.zeros(1, dtype=np.int64)
        allowed = how.columns(number, len(layout.cuts))
        for level in range(how.depth):
            total = sums(trees, tree, open_)
            if level == 0:
                tree.value[0] = how.leaf(total[:, 0, -1])
            open_ = grow_level(tree, open_, best_splits(total, layout, how.gain, np.repeat(allowed, len(open_), axis=0)), layout, how.leaf)
            if not len(open_):
                break
        trees.append(tree)
    return trees


def start_margin(positive: float, total: float) -> float:
    """Log odds of the weighted share of positive rows."""
    p = min(max(positive / total if total else 0.5, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def class_weight(block: Block | Lean, how: Boost) -> np.ndarray:
    """(weight of positive rows, of all rows)."""
    w = (1.0 if block.w is None else block.w) * np.where(block.y == 1, how.positive_weight, 1.0)
    return np.array([w[block.y == 1].sum(), w.sum()])


def margins(block: Block | Lean, trees: list[Tree], start: float) -> np.ndarray:
    """A block's margins: what is stored with it, and these trees."""
    margin = np.full(len(block.y), start) if block.margin is None else block.margin
    for tree in trees:
        margin = margin + tree.value[block.ends(tree)]
    return margin


def boost_blocks(blocks, layout: Layout, how: Boost) -> tuple[list[Tree], float]:
    """Boosted trees over an RDD of blocks: one job a level; a tree's first job also adds the last tree to the margins."""
    start = start_margin(*blocks.map(lambda b: class_weight(b, how)).reduce(np.add).tolist())
    held, done = blocks.map(lambda b: Lean.of(b, layout)).persist(StorageLevel.MEMORY_AND_DISK), 0  # margins have the first ``done`` trees

    def sums(trees, tree, open_):
        nonlocal held, done
        number, before = len(trees), None
        if number > done:
            last, before, done = trees[-1], held, number
            held = before.map(lambda b: replace(b, margin=margins(b, [last], start))).persist(StorageLevel.MEMORY_AND_DISK)
            if number % STORED_EVERY == 0:
                checkpoint_dir(SparkSession.builder.getOrCreate())
                held.checkpoint()  # cuts the lineage; a lost executor's blocks are read again
        found = held.map(lambda b: boost_sums(b, layout, how, number, margins(b, [], start), tree, open_)).reduce(np.add)
        if before is not None:
            before.unpersist()
        return found
    trees = boost_rounds(layout, how, start, sums)
    held.unpersist()
    return trees, start


class Growing:
    """A block's rows while trees grow over them: their margins, their gradients and the nodes where they are."""

    def __init__(self, block: Block | Lean, layout: Layout, how: Boost, start: float):
        self.lean = block if isinstance(block, Lean) else Lean.of(block, layout)
        self.columns, self.layout, self.how = self.lean.columns(), layout, how
        self.margin, self.tree = np.full(len(block.y), start), None

    def sums(self, trees: list[Tree], tree: Tree, open_: np.ndarray) -> np.ndarray:
        """What the rows add to the open nodes' sums of gradients and hessians."""
        lean, how = self.lean, self.how
        if self.tree is not None:
            self.at = self.tree.step(self.columns, self.at)  # rows at nodes that were split go on to the children
        if self.tree is not tree:
            if self.tree is not None:
                self.margin = self.margin + self.tree.value.take(self.at)
            self.tree, self.at = tree, np.zeros(len(lean.y), dtype=np.int64)
            channels = lean.channels(how, self.margin)
            self.own = np.flatnonzero(draw(lean.key, how.seed, len(trees), 0) < how.subsample) if how.subsample < 1 else None
            self.drawn = (lean.number, lean.hot, channels)
            if self.own is not None:
                self.drawn = ([c.take(self.own) for c in lean.number], lean.hot.take(self.own, axis=0), [v.take(self.own) for v in channels])
        node = np.full(len(tree.slot), len(open_), dtype=np.int64)
        node[open_] = np.arange(len(open_))
        at = node.take(self.at if self.own is None else self.at.take(self.own))
        number, hot, channels = self.drawn
        return histogram(number, hot, self.layout, at, len(open_), channels)


def boost_rows(block: Block | Lean, layout: Layout, how: Boost) -> tuple[list[Tree], float]:
    """The same over one block, where it is."""
    start = start_margin(*class_weight(block, how).tolist())
    return boost_rounds(layout, how, start, Growing(block, layout, how, start).sums), start


# ---------------------------------------------------------------- forests
@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 12
    min_leaf: int = 1
    slots: str | float = "sqrt"
    seed: int = 42

    def gain(self, left, right, total):
        def pure(s):
            one, every, _ = s
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(every > 0, (one * one + (every - one) ** 2) / every, 0.0)
        value = pure(left) + pure(right) - pure(total)
        return np.where((left[2] >= self.min_leaf) & (right[2] >= self.min_leaf) & (left[1] > 0) & (right[1] > 0), value, -np.inf)

    def leaf(self, sums):
        return np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], EPSILON), 0.5)

    def width(self, width: int) -> int:
        n = {"sqrt": width ** 0.5, "log2": np.log2(max(width, 2)), "all": width}.get(self.slots, None)
        n = float(self.slots) * width if n is None else n
        return min(width, max(1, int(n)))

    def allowed(self, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
        """The random few slots at which each node may split."""
        keys = (nodes[:, None] * (1 << 20) + np.arange(width)[None, :]).astype(np.uint64)
        order = draw(keys.ravel(), self.seed, tree, 2).reshape(keys.shape)
        n = self.width(width)
        limit = np.partition(order, n - 1, axis=1)[:, n - 1:n]
        return order <= limit


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


@dataclass
class Part:
    """What growing a tree reads of its rows, a record of bytes each: codes of numbers, one-hot slots present (the vector's
    width: fewer), label and draws. Rows of a node lie together once they are ``sorted``."""

    record: np.ndarray  # (rows, bytes); the last two are the label and the draws
    one: np.ndarray | None  # weights of label 1 and weights, where they aren't the draws; else None
    every: np.ndarray | None
    at: np.ndarray

    def rows(self, some: slice) -> Part:
        """A run of rows, not copied."""
        return Part(self.record[some], None if self.one is None else self.one[some], None if self.every is None else self.every[some], self.at[some])

    def take(self, some: np.ndarray, at: np.ndarray | None = None) -> Part:
        record = self.record.view(f"V{self.record.shape[1]}").ravel().take(some).view(np.uint8).reshape(-1, self.record.shape[1])
        weights = (None, None) if self.one is None else (self.one[some], self.every[some])
        return Part(record, *weights, self.at[some] if at is None else at)

    @classmethod
    def of(cls, block: Block, layout: Layout) -> Part:
        """A block's rows, each once and at no node yet."""
        y, n, hot = block.y.astype(np.uint8), len(block.y), block.present(layout)
        hot = np.where(hot < 0, len(layout.cuts), hot).astype(hot_type(layout))
        parts = (block.codes[:, ~layout.sparse], np.ascontiguousarray(hot).view(np.uint8).reshape(n, -1), y[:, None], np.ones((n, 1), np.uint8))
        plain = (y == block.y).all() and (block.w == 1).all()
        return cls(np.ascontiguousarray(np.concatenate(parts, axis=1)), None if plain else block.w * block.y, None if plain else block.w.astype(float),
                   np.zeros(n, np.int32))

    @classmethod
    def joined(cls, parts: list[Part], layout: Layout) -> Part:
        if len(parts) == 1:
            return parts[0]
        wide, none = max(p.record.shape[1] for p in parts), np.array([len(layout.cuts)], hot_type(layout)).view(np.uint8)
        # rows of a block have as many one-hot slots as its fullest row
        record = [np.concatenate([p.record[:, :-2], np.tile(none, (len(p.at), (wide - p.record.shape[1]) // len(none))), p.record[:, -2:]], axis=1)
                  if p.record.shape[1] < wide else p.record for p in parts]
        one = every = None
        if any(p.one is not None for p in parts):
            one, every = (np.concatenate(v) for v in zip(*(p.weights() for p in parts)))
        return cls(np.concatenate(record), one, every, np.concatenate([p.at for p in parts]))

    def hot(self, layout: Layout, rows) -> list[np.ndarray]:
        """One-hot slots that are present in some rows, the first of each, the second of each and so on."""
        kind, low, width = hot_type(layout), int((~layout.sparse).sum()), self.record.shape[1]
        if kind.itemsize > 1:
            return list(np.ascontiguousarray(self.record[rows, low:-2]).view(kind).T)
        if isinstance(rows, slice):
            return [self.record[rows, k] for k in range(low, width - 2)]
        place, flat = rows * width, self.record.ravel()
        return [flat[place + k] for k in range(low, width - 2)]

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's weight of label 1, and its weight."""
        if self.one is not None:
            return self.one, self.every
        times = self.record[:, -1].astype(float)
        return times * self.record[:, -2], times

    def channels(self, some=slice(None), times: np.ndarray | None = None) -> list[np.ndarray]:
        """What is summed over some rows, ``times`` their draws beside those held: without weights both sums in one whole
        number, else (of label 1, of all, draws)."""
        held = self.record[some, -1]
        if self.one is None:
            return [(held if times is None else held * times) * (1.0 + self.record[some, -2] * 2.0 ** 26)]
        many = 1.0 if times is None else times
        return [self.one[some] * many, self.every[some] * many, held * many * 1.0]

    def times_drawn(self, times: np.ndarray) -> Part:
        """Rows with their draws."""
        record = self.record.copy()
        record[:, -1] = times
        weights = (None, None) if self.one is None else (self.one * times, self.every * times)
        return Part(record, *weights, self.at)


def hot_type(layout: Layout):
    return np.min_scalar_type(len(layout.cuts))


def three(sums: list[np.ndarray]) -> np.ndarray:
    """(weight of label 1, weight, draws) of the channels' sums."""
    if len(sums) == 3:
        return np.stack(sums)
    one = np.floor(sums[0] * 2.0 ** -26)
    rest = sums[0] - one * 2.0 ** 26
    return np.stack([one, rest, rest])


def node_splits(part: Part, count: np.ndarray, layout: Layout, how: Forest, allowed: np.ndarray):
    """:func:`best_splits` of nodes whose rows lie one node after the other, ``count`` of each; also the nodes' sums. Only
    the slots at which a node may split are summed."""
    columns = np.flatnonzero(~layout.sparse)
    column, sizes = np.cumsum(~layout.sparse) - 1, np.diff(layout.offsets)
    nodes, wide, channels = len(count), int(sizes[columns].max(initial=1)), part.channels()
    at, start = np.repeat(np.arange(nodes), count), np.cumsum(count) - count
    total = three([np.add.reduceat(v, start) if count.all() else np.bincount(at, v, nodes) for v in channels])
    node, slot = np.nonzero(allowed)
    number = ~layout.sparse[slot]
    left = np.empty((3, len(node)))
    value, cut = np.full(len(node), -np.inf), np.zeros(len(node), dtype=np.int64)
    some = np.flatnonzero(number)
    if len(some):
        sums = [np.zeros((len(some), wide)) for _ in channels]
        large = count[node[some]] > ROWS_AT_ONCE
        for i in np.flatnonzero(large).tolist():
            rows = slice(start[node[some[i]]], start[node[some[i]]] + count[node[some[i]]])
            for s, v in zip(sums, channels):
                s[i] = np.bincount(part.record[rows, column[slot[some[i]]]], v[rows], wide)
        other = np.flatnonzero(~large)
        for own in np.split(other, np.flatnonzero(np.diff(np.cumsum(count[node[some[other]]]) // ROWS_AT_ONCE)) + 1):
            many = count[node[some[own]]]
            row = ragged(start[node[some[own]]], many)
            code = part.record.ravel()[row * part.record.shape[1] + np.repeat(column[slot[some[own]]], many)]
            place = np.repeat(np.arange(len(own)) * wide, many) + code
            for s, v in zip(sums, channels):
                s[own] = np.bincount(place, v[row], len(own) * wide).reshape(len(own), wide)
        sums = three(sums)
        lefts, every = np.cumsum(sums, axis=2)[:, :, :-1], total[:, node[some]][:, :, None]
        if lefts.shape[2]:
            gains = np.where(np.arange(wide - 1) < sizes[slot[some]][:, None] - 1, how.gain(lefts, every - lefts, every), -np.inf)
            cut[some] = gains.argmax(axis=1)
            value[some] = gains[np.arange(len(some)), cut[some]]
            left[:, some] = lefts[:, np.arange(len(some)), cut[some]]
    some = np.flatnonzero(~number)
    if len(some):
        width = allowed.shape[1] + 1
        pair = np.full(nodes * width, len(some))
        pair[node[some] * width + slot[some]] = np.arange(len(some))
        sums = [np.zeros(len(some)) for _ in channels]
        for low in range(0, len(at), ROWS_AT_ONCE):
            rows = slice(low, low + ROWS_AT_ONCE)
            base = at[rows] * width
            for hot in part.hot(layout, rows):
                place = pair[base + hot]
                own = np.flatnonzero(place < len(some))
                for s, v in zip(sums, channels):
                    s += np.bincount(place[own], v[rows][own], len(s))
        every = total[:, node[some]]
        left[:, some] = every - three(sums)
        value[some] = how.gain(left[:, some], every - left[:, some], every)
    first = np.searchsorted(node, np.arange(nodes))
    top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(node)))))
    best = top[np.searchsorted(node[top], np.arange(nodes))]
    return (value[best], layout.offsets[slot[best]] + cut[best], left[:, best], total - left[:, best]), total


def to_children(part: Part, count: np.ndarray, layout: Layout, slot: np.ndarray, cut: np.ndarray, open_: np.ndarray) -> tuple[Part, np.ndarray]:
    """Rows at nodes that split (``slot`` -1: the others) go on to the open ones of their children, left and right in turn,
    and lie one child after the other; how many there are of each."""
    columns, start, width = np.cumsum(~layout.sparse) - 1, np.cumsum(count) - count, part.record.shape[1]
    right = np.zeros(len(part.record), dtype=bool)
    number = (slot >= 0) & ~layout.sparse[slot]
    some = np.flatnonzero(number)
    if len(some):
        row = ragged(start[some], count[some])
        right[row] = part.record.ravel()[row * width + np.repeat(columns[slot[some]], count[some])] > np.repeat(cut[some].astype(np.uint8), count[some])
    some = np.flatnonzero((slot >= 0) & ~number)
    if len(some):
        row = ragged(start[some], count[some])
        want, found = np.repeat(slot[some].astype(hot_type(layout)), count[some]), np.zeros(len(row), dtype=bool)
        for hot in part.hot(layout, row):
            found |= hot == want
        right[row] = found
    split = np.flatnonzero(slot >= 0)
    open_ = open_.reshape(-1, 2)
    kept, many = [], np.zeros(open_.shape, dtype=np.int64)
    for side, goes in enumerate((~right, right)):
        stays = np.zeros(len(slot), dtype=bool)
        stays[split] = open_[:, side]
        rows = np.flatnonzero(goes & np.repeat(stays, count))
        edges = np.searchsorted(rows, np.append(start, len(right)))
        many[:, side] = np.diff(edges)[split]
        kept.append(rows)
    counts = many.ravel()
    to = (np.cumsum(counts) - counts).reshape(-1, 2)
    order = np.empty(int(counts.sum()), dtype=np.int64)
    for side, rows in enumerate(kept):
        order[ragged(to[:, side], many[:, side])] = rows
    return part.take(order, part.at[:0]), counts[open_.ravel()]


def forest_sums(block: Block, part: Part, columns: np.ndarray, layout: Layout, how: Forest, number: int, tree: Tree,
                open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counters, sums) that a block adds to a tree's open nodes, of the slots at which they may split."""
    times = poisson(block.key, how.seed, number).astype(np.uint8)
    total, allowed = np.zeros((3, len(open_), layout.size + 1)), how.allowed(number, open_, len(layout.cuts))
    for i, inside in enumerate(inside_of(columns, tree, open_)):
        own = np.flatnonzero(inside & (times > 0))
        channels = part.channels(own, times[own])
        for slot in np.flatnonzero(allowed[i]).tolist():
            at, code = slice(layout.offsets[slot], layout.offsets[slot + 1]), columns[slot][own]
            total[:, i, at] = three([np.bincount(code, v, at.stop - at.start) for v in channels])
        total[:, i, -1] = three([np.array([v.sum()]) for v in channels])[:, 0]
    where = np.flatnonzero(total[2] > 0)
    return where, total.reshape(3, -1)[:, where]


def inside_of(columns: np.ndarray, tree: Tree, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """Whether each row gets to a node, for some nodes of a tree."""
    parent = np.zeros(len(tree.slot), dtype=np.int64)
    inner = np.flatnonzero(tree.slot >= 0)
    parent[tree.left[inner]] = parent[tree.right[inner]] = inner
    for node in nodes.tolist():
        inside = np.ones(columns.shape[1], dtype=bool)
        while node:
            up = int(parent[node])
            column, cut = columns[tree.slot[up]], np.uint8(tree.cut[up])
            inside &= column <= cut if tree.left[up] == node else column > cut
            node = up
        yield inside


def drawn(block: Block, part: Part, columns: np.ndarray | None, how: Forest, number: int, tree: Tree, nodes: np.ndarray) -> Part:
    """The rows that a tree has drawn at these nodes, at the nodes' places in the list. (A stump needs no columns.)"""
    times = poisson(block.key, how.seed, number).astype(np.uint8)
    at = None
    if len(tree.slot) > 1:
        at = np.full(len(times), -1, dtype=np.int32)
        for i, inside in enumerate(inside_of(columns, tree, nodes)):
            at[inside] = i
    own = np.flatnonzero(times if at is None else (times > 0) & (at >= 0))
    return part.take(own, None if at is None else at[own]).times_drawn(times[own])


def _add(parts, count: int, size: int) -> np.ndarray:
    out = np.zeros((3, count * size))
    for where, values in parts:
        out[:, where] += values  # a part has a counter once
    return out.reshape(3, count, size)


def children(found, how: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Of the children of split nodes, left and right in turn: whether they may split further, and their draws."""
    gain, _, left, right = found
    some = gain > EPSILON
    one, every, count = (np.stack([a[some], b[some]], axis=1).ravel() for a, b in zip(left, right))
    return (count >= 2 * max(1, how.min_leaf)) & (one > 0) & (one < every), count


def grow_nodes(part: Part, layout: Layout, how: Forest, number: int, nodes: np.ndarray, levels: int) -> Tree:
    """What grows under some nodes of a tree, whose rows are all here; the first nodes of the result are these.

    A node draws its slots by its number. Under other nodes than the root the numbers in the whole tree aren't
    known here: there they are the node's and the way from it."""
    tree = Tree(*(np.repeat(v, len(nodes)) for v in vars(Tree.stump()).values()))
    whole = len(nodes) == 1 and nodes[0] == 0
    name = nodes.astype(np.int64) if whole else (nodes.astype(np.int64) << how.depth + 2) + 1
    shift = np.int64(0 if whole else 1) << how.depth + 2
    open_, count = np.arange(len(nodes)), np.bincount(part.at, minlength=len(nodes))
    if len(nodes) > 1:
        part = part.take(np.argsort(part.at, kind="stable"))
    for level in range(levels):
        founds, edge = [], np.concatenate(([0], np.cumsum(count)))
        low = 0
        while low < len(open_):
            high = max(low + 1, min(low + NODES_AT_ONCE, int(np.searchsorted(edge, edge[low] + ROWS_AT_ONCE, "right")) - 1))
            some = slice(low, high)
            found, total = node_splits(part.rows(slice(edge[low], edge[high])), count[some], layout, how, how.allowed(number, name[open_[some]], len(layout.cuts)))
            if whole and level == 0:
                tree.value[0] = how.leaf(total[:, 0])
            founds.append(found)
            low = high
        found = tuple(np.concatenate(v, axis=-1) for v in zip(*founds))
        new = grow_level(tree, open_, found, layout, how.leaf)
        if whole:
            name = np.arange(len(tree.slot))
        else:
            way = name[open_[found[0] > EPSILON]]
            top = way // shift * shift
            name = np.concatenate([name, np.stack([top + 2 * (way - top), top + 2 * (way - top) + 1], axis=1).ravel()])
        may, _ = children(found, how)
        if not may.any() or level + 1 == levels:
            break
        part, count = to_children(part, count, layout, tree.slot[open_], tree.cut[open_], may)
        open_ = new[may]
    return tree


def graft(tree: Tree, nodes: np.ndarray, grown: Tree) -> None:
    """Put what has grown under some of a tree's nodes in its place."""
    base, k = len(tree.slot), len(nodes)
    to = np.concatenate([nodes, base + np.arange(len(grown.slot) - k)]).astype(np.int32)
    for name in ("left", "right"):
        setattr(grown, name, np.where(grown.slot >= 0, to[getattr(grown, name)], 0).astype(np.int32))
    if k == 1 and nodes[0] == 0:
        tree.value[0] = grown.value[0]
    for name in ("slot", "cut", "left", "right", "gain"):
        getattr(tree, name)[nodes] = getattr(grown, name)[:k]
    for name in ("slot", "cut", "left", "right", "value", "gain"):
        setattr(tree, name, np.concatenate([getattr(tree, name), getattr(grown, name)[k:]]))


def shares_of(nodes: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Nodes in runs that have ``SMALL_ROWS`` rows together, twice as many at most."""
    run = (np.cumsum(rows) - rows / 2) // SMALL_ROWS
    for r in np.unique(run):
        yield nodes[run == r]


def forest_blocks(blocks, layout: Layout, how: Forest) -> list[Tree]:
    """All trees of a forest, as many at once as rows may be on their way."""
    rows = blocks.map(lambda b: len(b.y)).sum()
    at_once = max(1, min(how.trees, ON_THE_WAY // max(1, rows)))
    trees: list[Tree] = []
    for low in range(0, how.trees, at_once):
        trees += _grow_together(blocks, rows, layout, how, range(low, min(how.trees, low + at_once)))
    return trees


def _grow_together(blocks, rows: int, layout: Layout, how: Forest, numbers: range) -> list[Tree]:
    trees = {t: Tree.stump() for t in numbers}
    for tree in trees.values():
        tree.value[0] = 0.5  # it may have drawn no row
    small: list[tuple[int, int, np.ndarray]] = []  # (tree, level, nodes) that grow in one task
    open_ = {t: np.zeros(1, dtype=np.int64) for t in numbers}
    if rows <= SMALL_ROWS:
        small, open_ = [(t, 0, nodes) for t, nodes in open_.items()], {}
    size, shares = layout.size + 1, min(len(numbers), SHARES)
    # a block is read by several tasks, each for a share of the trees
    numbered = blocks.mapPartitionsWithIndex(lambda i, found: ((i, b) for b in found))
    shared = numbered.cartesian(blocks.context.parallelize(range(shares), shares))
    for level in range(how.depth):
        if not open_:
            break
        sent = blocks.context.broadcast({t: (trees[t], nodes) for t, nodes in open_.items()})  # rows / SMALL_ROWS open nodes a tree at most

        def sums(pair, sent=sent):
            (_, block), share = pair
            part, columns = Part.of(block, layout), block.columns()
            return ((t, forest_sums(block, part, columns, layout, how, t, tree, nodes)) for t, (tree, nodes) in sent.value.items() if t % shares == share)

        def split(item, sent=sent):
            t, parts = item
            nodes = sent.value[t][1]
            total = _add(parts, len(nodes), size)
            return t, total[:, 0, -1], best_splits(total, layout, how.gain, how.allowed(t, nodes, len(layout.cuts)))
        met = shared.flatMap(sums).map(lambda x: (x[0], [x[1]])).reduceByKey(_merged(size), numPartitions=_reducers(blocks, len(numbers)))
        for t, root, found in met.map(split).collect():
            if level == 0:
                trees[t].value[0] = how.leaf(root)
            new = grow_level(trees[t], open_[t], found, layout, how.leaf)
            may, count = children(found, how)
            large = may & (count > SMALL_ROWS)
            open_[t] = new[large]
            if level + 1 < how.depth:
                small += [(t, level + 1, nodes) for nodes in shares_of(new[may & ~large], count[may & ~large])]
        sent.unpersist()
        open_ = {t: nodes for t, nodes in open_.items() if len(nodes)}
    sent = blocks.context.broadcast((trees, small))

    def rows_of(pair):
        (at, block), share = pair
        held, groups = sent.value
        part, columns, of = Part.of(block, layout), block.columns() if any(len(t.slot) > 1 for t in held.values()) else None, {}
        for g, (t, _, nodes) in enumerate(groups):
            if t % shares == share:
                of.setdefault(t, []).append((g, nodes))
        for t, own in of.items():
            some = drawn(block, part, columns, how, t, held[t], np.concatenate([nodes for _, nodes in own]))
            edge = 0
            for g, nodes in own:
                inside = np.flatnonzero((some.at >= edge) & (some.at < edge + len(nodes)))
                if len(inside):
                    out = some.take(inside)
                    out.at = out.at - np.int32(edge)
                    yield g, (at, out)
                edge += len(nodes)

    def grow(item):
        g, parts = item
        t, level, nodes = sent.value[1][g]
        part = Part.joined([p for _, p in sorted(parts, key=lambda x: x[0])], layout)
        return g, grow_nodes(part, layout, how, t, nodes, how.depth - level)
    if small:
        # a few groups a task while they are small
        tasks = min(len(small), max(4 * blocks.context.defaultParallelism, -(-rows * len(numbers) // SMALL_ROWS)))
        met = shared.flatMap(rows_of).groupByKey(tasks, lambda g: g)
        for g, grown in sorted(met.map(grow).collect(), key=lambda x: x[0]):
            graft(trees[small[g][0]], small[g][2], grown)
    sent.unpersist()
    return [trees[t] for t in numbers]


def forest_rows(block: Block, layout: Layout, how: Forest) -> list[Tree]:
    """The same over one block, where it is."""
    part, root, out = Part.of(block, layout), np.zeros(1, dtype=np.int64), []
    for t in range(how.trees):
        tree = Tree.stump()
        some = drawn(block, part, None, how, t, tree, root)
        graft(tree, root, grow_nodes(some, layout, how, t, root, how.depth))
        out.append(tree)
    return out


def score_sum(block: Block | Lean, trees: list[Tree]) -> np.ndarray:
    """The sum of the trees' values for each row."""
    columns, total = block.columns(), np.zeros(len(block.y))
    for tree in trees:
        total += tree.value.take(tree.ends(columns))
    return total


def _reducers(blocks, trees: int) -> int:
    return min(trees, max(8, blocks.getNumPartitions()))


def _merged(size: int):
    """Parts of one tree's sums are added as soon as there are several."""
    def add(a: list, b: list) -> list:
        where = np.concatenate([w for w, _ in a + b])
        values = np.concatenate([v for _, v in a + b], axis=1)
        distinct, place = np.unique(where, return_inverse=True)
        return [(distinct, np.stack([np.bincount(place, v, len(distinct)) for v in values]))]
    return add


# ---------------------------------------------------------------- estimators
NODES = ("slot", "cut", "left", "right", "value", "gain")


class TreeModel(Model, MLReadable, MLWritable):
    """A fitted ensemble: ``prediction`` and ``tree_probability`` (of class 0 and 1)."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "boost or forest", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "slots of the vector", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self.table: pa.Table | None = None

    @classmethod
    def of(cls, trees: list[Tree], layout: Layout, features: str, kind: str, start: float = 0.0) -> TreeModel:
        """The trees as one table (tree, node, slot, threshold, left, right, value, gain)."""
        out = cls()._set(featuresCol=features, kind=kind, start=start, width=len(layout.cuts))
        rows = {"tree": [], "node": [], "slot": [], "threshold": [], "left": [], "right": [], "value": [], "gain": []}
        for number, t in enumerate(trees):
            limit = [float(layout.cuts[s][c]) if s >= 0 else 0.0 for s, c in zip(t.slot.tolist(), t.cut.tolist())]
            for name, v in zip(rows, (np.full(len(t.slot), number, np.int32), np.arange(len(t.slot), dtype=np.int32), t.slot, np.array(limit),
                                      t.left, t.right, t.value, t.gain)):
                rows[name].append(v)
        kinds = {"tree": np.int32, "node": np.int32, "slot": np.int32, "left": np.int32, "right": np.int32}
        out.table = pa.table({k: np.concatenate(v) if v else np.empty(0, kinds.get(k, float)) for k, v in rows.items()})
        return out

    def importances(self) -> np.ndarray:
        """Each slot's share of the gains: of all (boosting), or averaged over the trees' own shares (forest)."""
        t = {c: self.table.column(c).to_numpy() for c in ("tree", "slot", "gain")}
        width, inner = self.getOrDefault(self.width), t["slot"] >= 0
        trees = int(t["tree"].max()) + 1 if len(t["tree"]) else 0
        total = np.bincount(t["tree"][inner].astype(np.int64) * width + t["slot"][inner], t["gain"][inner], trees * width).reshape(trees, width)
        if self.getOrDefault(self.kind) == "forest":
            total = total / np.maximum(total.sum(axis=1, keepdims=True), EPSILON)
        total = total.sum(axis=0)
        return total / total.sum() if total.sum() > 0 else total

    def _transform(self, df: DataFrame) -> DataFrame:
        t = {c: self.table.column(c).to_numpy() for c in self.table.column_names}
        first = np.flatnonzero(t["node"] == 0)
        boost, start = self.getOrDefault(self.kind) == "boost", self.getOrDefault(self.start)
        trees = [{c: t[c][a:b] for c in ("slot", "threshold", "left", "right", "value")} for a, b in zip(first, [*first[1:], len(t["node"])])]
        width = self.getOrDefault(self.width)

        @F.pandas_udf(T.DoubleType())
        def positive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.concatenate(batch.to_numpy()).reshape(len(batch), width) if len(batch) else np.empty((0, width))
                total = np.full(len(x), start if boost else 0.0)
                for tree in trees:
                    total += tree["value"][_ends(tree, x)]
                yield pd.Series(1 / (1 + np.exp(-total)) if boost else total / max(1, len(trees)))
        p = F.col("_positive")
        out = df.withColumn("_positive", positive(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        return out.withColumn("tree_probability", F.array(1 - p, p)).withColumn("prediction", (p > 0.5).cast("double")).drop("_positive")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _ends(tree: dict, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    going = np.arange(len(x)) if tree["slot"][0] >= 0 else np.empty(0, np.int64)
    while len(going):
        here = at[going]
        to = np.where(x[going, tree["slot"][here]] <= tree["threshold"][here], tree["left"][here], tree["right"][here])
        at[going] = to
        going = going[tree["slot"][to] >= 0]
    return at


class _Writer(MLWriter):
    def __init__(self, model: TreeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame(self.model.table).write.parquet(path + "/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> TreeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TreeModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        rows = self.sparkSession.read.parquet(path + "/nodes").toArrow()
        model.table = rows.sort_by([("tree", "ascending"), ("node", "ascending")])
        return model


class _Trees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights (empty: all 1)", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "key that row draws hash", TypeConverters.toString)
    bins = Param(Params._dummy(), "bins", "cuts of a number, plus one", TypeConverters.toInt)

    def __init__(self, how=None, featuresCol="features", labelCol="label", weightCol="", keyCol="order_id", bins=32):
        super().__init__()
        self.how = how
        self._set(featuresCol=featuresCol, labelCol=labelCol, weightCol=weightCol or "", keyCol=keyCol, bins=bins)

    def _binned(self, df: DataFrame):
        features = self.getOrDefault(self.featuresCol)
        layout = layout_of(df, features, self.getOrDefault(self.bins))
        blocks = blocks_of(df, layout, features, self.getOrDefault(self.labelCol), self.getOrDefault(self.weightCol) or None,
                              self.getOrDefault(self.keyCol))
        return layout, blocks


class BoostedTrees(_Trees):
    """Second-order boosted trees for labels 0 and 1."""

    def _fit(self, df: DataFrame) -> TreeModel:
        layout, blocks = self._binned(df)
        if blocks.isEmpty():
            raise ValueError("no rows to fit on")
        trees, start = boost_blocks(blocks, layout, self.how or Boost())
        blocks.unpersist()
        return TreeModel.of(trees, layout, self.getOrDefault(self.featuresCol), "boost", start)


class RandomForest(_Trees):
    """A forest of Gini trees for labels 0 and 1."""

    def _fit(self, df: DataFrame) -> TreeModel:
        layout, blocks = self._binned(df)
        if blocks.isEmpty():
            raise ValueError("no rows to fit on")
        trees = forest_blocks(blocks, layout, self.how or Forest())
        blocks.unpersist()
        return TreeModel.of(trees, layout, self.getOrDefault(self.featuresCol), "forest")
