"""Documents as chunks, and keys exchanged between chunks.

The operators that look for text repeated across documents, or that need
corpus counts for every token, all have the same shape: a chunk of documents
(about ``chunk_bytes`` of text) derives sorted distinct keys, the keys meet
in ``shards`` by value, and each chunk gets an answer for each of its keys.
Keys travel as packed sorted arrays (delta, byte planes, zstd), a few bytes
each, and an answer is one bit or one number per key in the chunk's own key
order, which the chunk can derive again. A key that is frequent in a chunk
travels once, so a hot key costs one entry a chunk.

Chunks are ranges of doc_id with at most ``chunk_bytes`` of text (and
``ROW_BYTES`` a row), by exact sums of bytes for each id, unless one text is
longer. An id (null is one) with more than that is a range of its own, dealt
to several chunks of one group. "In a smaller document" across chunks is "in
a chunk of an earlier group". Null ids sort first, as in Spark.
"""

from __future__ import annotations

import gc
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import materialize

NULL_ID = np.iinfo(np.int64).min
ROW_BYTES = 16  # that a row counts beside its text


def pack_array(values: np.ndarray) -> bytes:
    """Bytes of an array: byte planes (equal bytes lie together), zstd."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_array(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    if len(planes) == 0:
        return np.empty(0, dtype)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Bytes of a sorted uint64 array, as differences."""
    return pack_array(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(blob, np.uint64), dtype=np.uint64)


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


def pack_parts(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    sizes = np.array([len(parts), *map(len, parts)], dtype=np.int64)
    return sizes.tobytes() + b"".join(parts)


def unpack_parts(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 * (n + 1) + np.concatenate(([0], np.cumsum(sizes)))
    return [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Chunks:
    """The rows of ``docs`` by chunk, stored once on the executors' disks.

    ``frame`` has (chunk, n_bytes, rows): pieces of a chunk, each an Arrow
    stream with zstd. It is hash-partitioned by chunk, so grouping by chunk
    moves nothing. The lineage stays: a lost executor's part is read again.
    The results of ``finish`` are lazy and read the stored chunks, so these
    stay until ``release_all`` (or the end of the session).
    """

    stored: list[DataFrame] = []

    def __init__(self, docs: DataFrame, doc_id: str, text: str, chunk_bytes: int):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).head()
        self.n_bytes, self.n_rows = int(size[0] or 0), int(size[1])
        self.doc_id, self.text, self.schema = doc_id, text, docs.schema
        ranges = _ranges(docs, doc_id, text, self.n_bytes + ROW_BYTES * self.n_rows, chunk_bytes)
        self.cuts = np.array([first for first, _ in ranges[1:]], dtype=np.int64)
        # chunks of each range; half full, as rows of one id are dealt by hash
        dealt = np.array([1 if n <= chunk_bytes else -(-2 * n // chunk_bytes) for _, n in ranges], dtype=np.int64)
        self.groups = np.repeat(np.arange(len(ranges)), dealt)  # of each chunk
        self.count = len(self.groups)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(self.count, 100_000))
        packed = docs.mapInArrow(_packer(self.cuts, dealt, doc_id, text, 32 << 20), "chunk long, n_bytes long, rows binary")
        self.frame = packed.repartition(parts, "chunk").persist(StorageLevel.DISK_ONLY)
        self.frame.count()  # stored now, so that later plans know how it is partitioned
        Chunks.stored.append(self.frame)

    def emit(self, make: Callable, answers: DataFrame | None = None) -> DataFrame:
        """(shard, chunk, payload) rows of ``make(chunk, table, answers)``."""
        return self._each(lambda *a: [(s, c, p) for c in (a[0],) for s, p in make(*a)],
                          pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())]),
                          "shard long, chunk long, payload binary", answers)

    def finish(self, make: Callable, schema: pa.Schema, spark_schema, answers: DataFrame | None) -> DataFrame:
        """The rows of the table that ``make(chunk, table, answers)`` returns."""
        return self._each(make, schema, spark_schema, answers)

    def _each(self, make, schema, spark_schema, answers) -> DataFrame:
        def run(chunk, pieces, got):
            out = make(chunk, _rows(pieces), got)
            if isinstance(out, pa.Table):
                return out
            return pa.table([pa.array(list(x), t) for x, t in zip(zip(*out), schema.types)]
                            if out else [pa.array([], t) for t in schema.types], schema=schema)

        if answers is None:
            return self.frame.groupBy("chunk").applyInArrow(
                lambda key, left: run(key[0].as_py(), left, {}), spark_schema)

        def both(key, left, right):
            if left.num_rows == 0:
                return schema.empty_table()
            got = {}
            for kind, shard, payload in zip(*(right.column(n).to_pylist() for n in ("kind", "shard", "payload"))):
                got.setdefault(kind, {})[shard] = payload
            return run(key[0].as_py(), left, got)

        return (self.frame.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                .applyInArrow(both, spark_schema))

    @classmethod
    def release_all(cls) -> None:
        """Free the chunks of all results that have been written or read."""
        while cls.stored:
            cls.stored.pop().unpersist()


def answer(payloads: DataFrame, kind: str, solve: Callable) -> DataFrame:
    """(chunk, kind, shard, payload), stored: for each shard,
    ``solve(shard, [chunk, ...], [payload, ...])`` gives (chunk, payload) pairs."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("shard", pa.int64()), ("payload", pa.binary())])

    def run(key, table):
        shard = key[0].as_py()
        order = table.sort_by("chunk")
        rows = [(c, kind, shard, p) for c, p in
                solve(shard, order.column("chunk").to_pylist(), order.column("payload").to_pylist())]
        return pa.table([pa.array(list(x), t) for x, t in zip(zip(*rows), schema.types)]
                        if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return materialize(payloads.groupBy("shard").applyInArrow(
        run, "chunk long, kind string, shard long, payload binary"))


def earlier_group(order: np.ndarray, new: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether an equal key has an earlier group, for keys whose stable
    ``order`` has a new key at ``new``; ``groups`` don't fall."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), dtype=bool)
    out[order] = groups[order] > groups[order][first]
    return out


def _ranges(docs: DataFrame, doc_id: str, text: str, n_bytes: int, chunk_bytes: int) -> list[tuple[int, int]]:
    """(first id, bytes) of each range of ids, in order: as many as there are chunks."""
    if n_bytes <= chunk_bytes:
        return [(NULL_ID, n_bytes)]
    sizes = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("n"))
    sizes = sizes.groupBy("id").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, size = [], None, 0
        for b in batches:
            ids, total = np.asarray(b.column(0)), np.cumsum(np.asarray(b.column(1)))
            i, before = 0, 0
            while i < len(ids):
                j = max(i, int(np.searchsorted(total, before + chunk_bytes - size, "right")))
                if first is None:
                    first, j = int(ids[i]), max(j, i + 1)
                if j > i:
                    size, before, i = size + int(total[j - 1]) - before, int(total[j - 1]), j
                if i < len(ids):  # the next id has no room
                    out.append((first, size))
                    first, size = None, 0
        if first is not None:
            out.append((first, size))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "n"])
    parts = max(4, n_bytes // chunk_bytes // 32)
    found = sizes.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, "id long, n long").collect()
    ranges: list[tuple[int, int]] = []
    for first, n in sorted((r["id"], r["n"]) for r in found):
        if ranges and ranges[-1][1] + n <= chunk_bytes:  # at the borders of partitions
            ranges[-1] = (ranges[-1][0], ranges[-1][1] + n)
        else:
            ranges.append((first, n))
    return ranges


def _packer(cuts: np.ndarray, dealt: np.ndarray, doc_id: str, text: str, flush: int):
    base = np.cumsum(dealt) - dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        copies: dict[tuple[int, int], int] = {}
        part = TaskContext.get().partitionId()

        def place(r, value):
            """A chunk of a range that has several: by the text, its copies in turn, whatever the order of rows."""
            h = xxhash.xxh64_intdigest((value or "").encode())
            copies[r, h] = n = copies.get((r, h), -1) + 1
            return base[r] + (h + n + 7919 * part) % int(dealt[r])

        def out():
            chunks = sorted(held)
            blobs = [_write(pa.Table.from_batches(held[c])) for c in chunks]
            sizes = [sum(b.nbytes for b in held[c]) for c in chunks]
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(sizes, pa.int64()),
                                               pa.array(blobs, pa.binary())], names=["chunk", "n_bytes", "rows"])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk = np.searchsorted(cuts, ids_of(batch.column(batch.schema.get_field_index(doc_id))), "right")
            several = np.flatnonzero(dealt[chunk] > 1)
            values = batch.column(batch.schema.get_field_index(text)).take(pa.array(several)).to_pylist()
            ranges, chunk = chunk, base[chunk]
            chunk[several] = [place(int(r), v) for r, v in zip(ranges[several], values)]
            order = np.argsort(chunk, kind="stable")
            bounds = np.flatnonzero(np.diff(chunk[order])) + 1
            for rows in np.split(order, bounds):
                held.setdefault(int(chunk[rows[0]]), []).append(batch.take(pa.array(rows)))
            size += batch.nbytes
            if size >= flush:
                yield out()
                held, size = {}, 0
        if held:
            yield out()
    return run


def ids_of(column) -> np.ndarray:
    """An integer column as int64, nulls as the smallest number."""
    return np.asarray(column.cast(pa.int64()).fill_null(NULL_ID))


def _write(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as w:
        w.write_table(table)
    return sink.getvalue()


def _rows(pieces: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.BufferReader(b)).read_all()
                             for b in pieces.column("rows").to_pylist()])


def forget_shuffles(spark) -> None:
    """Let Spark remove shuffle files that no live frame needs: they go when
    the driver's JVM finds their plans unreachable, so ask it to look."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
