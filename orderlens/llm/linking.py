"""Helpers for linking similar rows: block pairs, star forests, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import materialize


class Forest:
    """Connected groups of ``n`` rows, grown by arrays of links.

    ``label`` is the smallest row number of a row's group, so that a set of
    links of any size is kept as at most ``n`` - 1 links to the smallest row.
    """

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.label != np.arange(len(self.label)))
        return rows, self.label[rows]


def block_pairs(rows: DataFrame, key: str, spread: str, block_rows: int) -> DataFrame:
    """Split every key's rows into blocks of about ``block_rows`` rows and
    copy each row to the block pairs that it takes part in.

    Adds ``n_blocks``, ``block``, ``lo`` and ``hi`` (``lo`` <= ``hi``); the
    rows of one (key, lo, hi) are those of two blocks (of one if equal), so
    any two rows of a key meet in one group, and no group is larger than two
    blocks whatever the key's size. A key of one block is not copied.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("n_blocks"))
    out = rows.join(sizes, key)
    out = out.withColumn("block", F.pmod(F.xxhash64(spread), F.col("n_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return (out.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
            .drop("_other"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b).

    Alternates large-star and small-star steps as joins with the smallest
    neighbour. Every round is a checkpoint (no growing lineage, survives lost
    executors); the driver sees a count and a checksum a round, never links.
    Nodes without a link don't appear.
    """
    def smallest(edges: DataFrame, at: str) -> DataFrame:
        other = "b" if at == "a" else "a"
        return edges.groupBy(at).agg(F.min(other).alias("m"))

    def both(edges: DataFrame) -> DataFrame:
        pair = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        return edges.select(pair.alias("e")).select("e.a", "e.b")

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a > b").distinct())
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        sym = both(edges)
        # large star: neighbours above a node move to the node's smallest neighbour (or itself)
        large = (sym.join(smallest(sym, "a"), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct())
        # small star: a node and its neighbours below it move to the smallest of these
        low = smallest(large, "a")
        near = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(near.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
