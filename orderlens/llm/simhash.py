"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit where more than half of its word shingles'
64-bit hashes have it. Documents whose fingerprints differ in at most
``max_bits`` bits are linked; groups are what links reach.

Equal fingerprints are one class first. Classes meet in buckets that any two
close fingerprints share: with ``max_bits`` + r blocks of bits, some r blocks
are equal. Inside a bucket, distances to the reference fingerprints are
computed once for each member; by the triangle inequality two members are
further apart than the largest difference of these distances, so pairs are
taken in the order of the first distance, dropped at the first reference
that tells them apart, and only the survivors are compared. (Distances of 64
random bits to a reference all lie near 32, so references alone would leave
almost all pairs of the corpus to look at; hence the buckets.) Large buckets
are split into pairs of blocks. A bucket gives a forest, never all its pairs.

Defined results: a text without words has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; rows with equal ids
are one document in groups; rows with a null id get a fingerprint, but no
group; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import text_slices
from .linking import Forest, block_pairs, components

BUCKET = 512  # classes that a bucket may hold on average before blocks get finer
PIVOTS = np.array([xxhash.xxh64_intdigest(f"reference {i}".encode()) for i in range(16)], dtype=np.uint64)


def _hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[shingle - 1:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(starts))


def _majority(hashes: list[np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """A fingerprint for each array of hashes."""
    n = np.array([len(h) for h in hashes], dtype=np.int64)
    doc = np.repeat(np.arange(len(hashes)), n)
    every = np.concatenate(hashes) if len(doc) else np.empty(0, np.uint64)
    ones = np.zeros((len(hashes), 64), dtype=np.int64)
    for at in range(0, len(every), block):
        bits = np.unpackbits(every[at:at + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = doc[at:at + block]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the fingerprint as a signed 64-bit number."""
    docs = docs.select(doc_id, text)
    schema = T.StructType([docs.schema[doc_id], T.StructField("fingerprint", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text, 1 << 20):
            found = _majority([_hashes((t or "").encode(), shingle, seed) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], schema=arrow)
    return docs.mapInArrow(run, schema)


def _close_pairs(group: np.ndarray, block: np.ndarray, split: np.ndarray, marks: np.ndarray, max_bits: int) -> Forest:
    """Links between rows of equal ``group``, which are sorted by their first distance."""
    table = np.bitwise_count(marks[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    forest = Forest(len(marks))
    left, step = np.arange(len(marks) - 1), 1
    while len(left):
        left = left[left + step < len(marks)]
        right = left + step
        near = (group[right] == group[left]) & (table[right, 0] - table[left, 0] <= max_bits)
        left, right = left[near], right[near]  # later rows are further still
        some = ~split[left] | (block[left] != block[right])  # pairs inside a block meet in its own group
        i, j = left[some], right[some]
        for k in range(1, len(PIVOTS)):
            if not len(i):
                break
            near = np.abs(table[i, k] - table[j, k]) <= max_bits
            i, j = i[near], j[near]
        close = np.bitwise_count(marks[i] ^ marks[j]) <= max_bits
        forest.add(i[close], j[close])
        step += 1
    return forest


def links(classes: DataFrame, n_classes: int, max_bits: int = 4, block_rows: int = 2048) -> DataFrame:
    """(a, b): links that connect all ``node`` with close ``fingerprint``."""
    spare = 1
    while n_classes / 2 ** (64 * spare / (max_bits + spare)) > BUCKET and spare < 8:
        spare += 1
    edges = [round(64 * i / (max_bits + spare)) for i in range(max_bits + spare + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in chosen) for chosen in combinations(zip(edges[:-1], edges[1:]), spare)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
                     for i, m in enumerate(masks)))
    rows = classes.select(F.explode(keys).alias("key"), "fingerprint", "node")
    pivot = int(PIVOTS[:1].view(np.int64)[0])
    rows = (block_pairs(rows, "key", "fingerprint", block_rows).repartition("key", "lo", "hi")
            .withColumn("_first", F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(pivot))))
            .sortWithinPartitions("key", "lo", "hi", "_first"))

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        key, lo, hi, block, mark, node = (np.asarray(t.column(c)) for c in ("key", "lo", "hi", "block", "fingerprint", "node"))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        a, b = _close_pairs(np.cumsum(new), block, lo != hi, mark.view(np.uint64), max_bits).links()
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= 1 << 17:  # whole groups only; the last one goes on
                t = pa.Table.from_batches(held).combine_chunks()
                last = np.ones(size, dtype=bool)
                for c in ("key", "lo", "hi"):
                    v = np.asarray(t.column(c))
                    last &= v == v[-1]
                cut = size - int(last.sum())
                if cut:
                    yield flush(t.slice(0, cut).to_batches())
                    held, size = t.slice(cut).to_batches(), size - cut
        if held:
            yield flush(held)
    return rows.mapInArrow(run, "a long, b long")


def _of_one_id(marked: DataFrame, classes: DataFrame, doc_id: str) -> DataFrame:
    """(a, b): links between the fingerprints of rows that share an id."""
    several = marked.groupBy(doc_id).agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo < hi")
    pairs = marked.join(several.select(doc_id, "lo"), doc_id).where("fingerprint <> lo").select("fingerprint", "lo").distinct()
    lo = classes.select(F.col("fingerprint").alias("lo"), F.col("node").alias("b"))
    return pairs.join(classes.select("fingerprint", F.col("node").alias("a")), "fingerprint").join(lo, "lo").select("a", "b")


def group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id that links reach."""
    marked = materialize(fingerprints(docs, shingle, seed, doc_id, text))
    classes = materialize(marked.where(F.col(doc_id).isNotNull()).groupBy("fingerprint")
                          .agg(F.min(doc_id).cast("long").alias("node")))
    found = components(links(classes, classes.count(), max_bits).unionByName(_of_one_id(marked, classes, doc_id)))
    # rows with one fingerprint may be very many; the join splits them where they are
    named = classes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fingerprint", "left").select(
        doc_id, "fingerprint", F.when(F.col(doc_id).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without those that share a group with a smaller id; null ids stay."""
    found = group(docs, doc_id=doc_id, **settings)
    first = found.where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    if not docs.schema[doc_id].nullable:
        return docs.join(first, doc_id, "left_semi")
    return docs.join(first, doc_id, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
