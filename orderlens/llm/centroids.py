"""Centroid clustering: Lloyd's rounds on shards of dimensions.

Vectors are packed into blocks of rows, and a block is cut into shards of
columns that lie apart: (shard, block) is a column block. A round is

* column blocks: exact partial squared distances to their slice of the centroids;
* a reduce by block adds the partial distances of its shards and takes the nearest centroid;
* column blocks again, with their block's assignment: sums of their columns for each centroid;
* each shard's slice of a centroid becomes the floor of sum / count.

Column blocks are stored once, hash-partitioned by (shard, block), and never move again: what
travels in a round are partial distances (8 bytes for each vector, shard and centroid), assignments
(4 bytes for each vector and shard) and sums. Tasks get the centroids with their code: ``k`` times
``dims`` numbers, both parameters of the caller. All arithmetic is on integers, so results don't
depend on partitions. Column blocks come from a checkpoint, so a lost executor's are read again.

Defined results: a vector is kept with exactly ``dims`` components, none null or non-finite, and no
component so large that a squared distance could pass a long (2**61 / dims as a square); others take
no part and have no row. Rows with equal or null ids are vectors of their own; null ids come last as
first centroids, equal ids in the order of their components. Fewer than ``k`` vectors are as many
centroids; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import materialize

from .vectors import matrices

BLOCK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("columns", pa.binary())])


def pack(rows: DataFrame, dims: int, scale: int, shards: int, block_rows: int, vec_id: str, embedding: str) -> DataFrame:
    """(shard, block, ids, columns): the column blocks; the ids are with shard 0."""
    cuts = np.linspace(0, dims, shards + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for table, x in matrices(batches, "embedding", scale, block_rows, dims):
            ids = table.column("vec_id").to_pylist()
            parts = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(shards), pa.int64()), pa.array([block] * shards, pa.int64()),
                 pa.array([ids] + [None] * (shards - 1), BLOCK.types[2]), pa.array(parts, pa.binary())], schema=BLOCK)
            block += 1
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(
        run, "shard long, block long, ids array<bigint>, columns binary")


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: int, vec_id: str, embedding: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``<seed>:<id>``, in that order: ``k`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x in matrices(batches, "embedding", scale, 1024, dims):
            values = pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([table.column("vec_id").combine_chunks(), values], names=["vec_id", "x"])
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(
        run, "vec_id long, x array<bigint>")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(len(found), dims)


def _partial(columns: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over these columns, a row for each vector."""
    out = np.empty((len(columns), len(centroids)), dtype=np.int64)
    for c, centre in enumerate(centroids):
        d = columns - centre
        np.einsum("ij,ij->i", d, d, out=out[:, c])
    return out


class Sharded:
    """Column blocks of vectors, and the two steps of a round over them."""

    def __init__(self, packed: DataFrame, dims: int, shards: int):
        cuts = np.linspace(0, dims, shards + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        self.packed = packed
        parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.frame = packed.select("shard", "block", "columns").repartition(parts, "shard", "block").persist(StorageLevel.DISK_ONLY)
        self.frame.count()  # stored now, so that later plans know how it is partitioned

    def nearest(self, centroids: np.ndarray) -> DataFrame:
        """(block, nearest, distance): of every block's vectors, as packed int32 and int64."""
        slices = self.slices

        def partial(table: pa.Table) -> pa.Table:
            where = slices[table.column("shard")[0].as_py()]
            x = _columns(table, where)
            return pa.table({"block": table.column("block"), "partial": [_partial(x, centroids[:, where]).tobytes()]})

        def add(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(p.as_py(), np.int64) for p in table.column("partial")]
            total = np.sum(parts, axis=0).reshape(-1, len(centroids))
            best = total.argmin(axis=1)  # the first of equal ones
            return pa.table({"block": [table.column("block")[0]], "nearest": [best.astype(np.int32).tobytes()],
                             "distance": [total[np.arange(len(total)), best].tobytes()]})
        parts = self.frame.groupBy("shard", "block").applyInArrow(partial, "block long, partial binary")
        return parts.groupBy("block").applyInArrow(add, "block long, nearest binary, distance binary")

    def update(self, centroids: np.ndarray, nearest: DataFrame) -> np.ndarray:
        """The centroids after one round: floor(sum / count) of their vectors, empty ones as they were."""
        slices, k = self.slices, len(centroids)

        def sums(blocks: pa.Table, assigned: pa.Table) -> pa.Table:
            where = slices[blocks.column("shard")[0].as_py()]
            x = _columns(blocks, where).astype(np.int64)
            to = np.frombuffer(assigned.column("nearest")[0].as_py(), np.int32)
            count = np.bincount(to, minlength=k)
            some = np.flatnonzero(count)
            order = np.argsort(to, kind="stable")
            starts = (np.cumsum(count) - count)[some]
            total = np.add.reduceat(x[order], starts, axis=0)
            n, width = total.shape
            return pa.table({"cluster": np.repeat(some, width), "dim": np.tile(np.arange(where.start, where.stop), n),
                             "total": total.ravel(), "n": np.repeat(count[some], width)})
        to_shards = nearest.select(F.explode(F.array(*(F.lit(s).cast("long") for s in range(len(slices))))).alias("shard"),
                                   "block", "nearest")
        found = self.frame.groupBy("shard", "block").cogroup(to_shards.groupBy("shard", "block")).applyInArrow(
            sums, "cluster long, dim long, total long, n long")
        # the sums of a slice are added and divided where its (cluster, dimension) is
        found = found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(
            "cluster", "dim", F.expr("(total - pmod(total, n)) div n").alias("value"))
        out = centroids.copy()
        for r in found.collect():  # k * dims rows at most
            out[r["cluster"], r["dim"]] = r["value"]
        return out


def _columns(table: pa.Table, where: slice) -> np.ndarray:
    return np.frombuffer(table.column("columns")[0].as_py(), np.int32).reshape(-1, where.stop - where.start)


def cluster(rows: DataFrame, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, shards: int = 4,
            block_rows: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, stored, and the final centroids."""
    schema = "vec_id long, cluster int, distance long"
    centroids = first_centroids(rows, k, dims, scale, seed, vec_id, embedding)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema), centroids
    data = Sharded(materialize(pack(rows, dims, scale, min(shards, dims), block_rows, vec_id, embedding)), dims, min(shards, dims))
    for _ in range(rounds):
        moved = data.update(centroids, data.nearest(centroids))
        if np.array_equal(moved, centroids):
            break  # no later round changes anything
        centroids = moved

    def unpack(ids: pa.Table, assigned: pa.Table) -> pa.Table:
        return pa.table({"vec_id": ids.column("ids").combine_chunks().flatten(),
                         "cluster": np.frombuffer(assigned.column("nearest")[0].as_py(), np.int32),
                         "distance": np.frombuffer(assigned.column("distance")[0].as_py(), np.int64)})
    ids = data.packed.where("shard = 0").select("block", "ids")
    out = materialize(ids.groupBy("block").cogroup(data.nearest(centroids).groupBy("block")).applyInArrow(unpack, schema))
    data.frame.unpersist()
    return out, centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the distances summed over each cluster and over all (null beyond a long)."""
    def total(c):
        return F.expr(f"try_cast(sum(cast({c} AS decimal(38,0))) AS bigint)")
    per = assigned.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    whole = assigned.agg(total("distance").alias("inertia"))
    # a row for each centroid, and one row
    return assigned.join(F.broadcast(per), "cluster").crossJoin(F.broadcast(whole))
