"""Substring dedup on words: count-min prefilter, then exact grouping.

A window is ``size`` consecutive words of one document. A word goes if some
window that covers it also starts in a document with a smaller id; windows
are judged on the input.

Pass 1: every chunk of documents counts its window hashes in a count-min
sketch of two rows; the sketches are merged by ranges of counters (each task
holds one range of one row, so the sketch may be as wide as the corpus
needs). Merged counts never fall below the true ones, so a window whose
counters nobody else has raised occurs in its own chunk alone. Pass 2: only
the other windows are exchanged, with 128-bit hashes, and grouped exactly.
What repeats inside a chunk is resolved there.

Defined results: a null text has no words; rows with equal ids are one
document (they don't remove each other's words); null ids sort before all
others; extra columns of any name are carried along unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import Texts, Words, covered, mix, per_text, span_hash, windows, word_hash
from .chunks import (Chunks, answer, earlier_group, ids_of, pack_array, pack_bits, pack_parts, pack_sorted, unpack_array,
                     unpack_bits, unpack_parts, unpack_sorted)

FULL = 255  # counters saturate here; a full counter always counts as repeated


class _Windows:
    """The windows of a chunk, by distinct content in hash order."""

    def __init__(self, table: pa.Table, text: str, size: int):
        self.texts = Texts.of(table.column(text))
        self.words = Words(self.texts)
        self.first = windows(self.words, size)
        h0, h1 = (span_hash(word_hash(self.texts, self.words, k), self.first, self.first + size, k) for k in (0, 1))
        order = np.lexsort((h1, h0))
        h0, h1 = h0[order], h1[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        self.at = np.flatnonzero(new)  # of each distinct window in the sorted order
        self.h0, self.h1, self.order = h0[self.at], h1[self.at], order
        self.counts = np.diff(self.at, append=len(order))

    def counters(self, row: int, bits: int) -> np.ndarray:
        """The counter of each distinct window in sketch row 0 or 1."""
        return (self.h0 if row == 0 else mix(self.h0 ^ np.uint64(0xA5A5A5A55A5A5A5A))) >> np.uint64(64 - bits)


def _by_shard(keys: np.ndarray, bits: int, shard_bits: int):
    """(shard, slice) of sorted ``keys`` of ``bits`` bits by their top bits."""
    edges = np.searchsorted(keys >> np.uint64(bits - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
    return [(s, slice(int(a), int(b))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50,
                   chunk_bytes: int = 4 << 20, counters_per_window: int = 8, replace: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the words that stay,
    joined by one space. With ``replace`` the rows of ``docs`` themselves,
    where a text that loses words is replaced by what it keeps.
    """
    source = docs if replace else docs.select(doc_id, text)
    chunks = Chunks(source, doc_id, text, chunk_bytes)
    groups = chunks.groups
    # fewer windows than blanks; a row of counters is a small multiple of that
    bits = min(60, max(16, math.ceil(math.log2(max(2, chunks.n_bytes / 5 * counters_per_window)))))
    shard_bits = max(0, bits - 25) if bits > 28 else min(3, bits - 16)
    shard_bits = max(shard_bits, min(4, bits - 16))

    def sketch(chunk, table, _):
        w = _Windows(table, text, size)
        for row in (0, 1):
            counter, inverse = np.unique(w.counters(row, bits), return_inverse=True)
            n = np.minimum(np.bincount(inverse, w.counts, len(counter)), FULL).astype(np.uint8)
            for s, part in _by_shard(counter, bits, shard_bits):
                yield (row << shard_bits) + s, pack_parts(pack_sorted(counter[part]), pack_array(n[part]))

    def merge(shard, owners, payloads):
        base = np.uint64(shard % (1 << shard_bits)) << np.uint64(bits - shard_bits)
        total = np.zeros(1 << (bits - shard_bits), dtype=np.uint8)
        parts = []
        for p in payloads:
            keys, n = unpack_parts(p)
            at, n = (unpack_sorted(keys) - base).astype(np.int64), unpack_array(n, np.uint8)
            total[at] = np.minimum(total[at].astype(np.uint16) + n, FULL)
            parts.append(p)
        for chunk, p in zip(owners, parts):
            keys, n = unpack_parts(p)
            at, n = (unpack_sorted(keys) - base).astype(np.int64), unpack_array(n, np.uint8)
            yield chunk, pack_bits((total[at] > n) | (n == FULL))

    def suspected(w: _Windows, got: dict) -> np.ndarray:
        """Which distinct windows may occur in another chunk."""
        found = np.ones(len(w.h0), dtype=bool)
        for row in (0, 1):
            counter, inverse = np.unique(w.counters(row, bits), return_inverse=True)
            bit = np.zeros(len(counter), dtype=bool)
            for s, part in _by_shard(counter, bits, shard_bits):
                bit[part] = unpack_bits(got["sketch"][(row << shard_bits) + s], part.stop - part.start)
            found &= bit[inverse]
        return found

    def exact(chunk, table, got):
        w = _Windows(table, text, size)
        some = suspected(w, got)
        h0, h1 = w.h0[some], w.h1[some]
        for s, part in _by_shard(h0, 64, shard_bits):
            yield s, pack_parts(pack_sorted(h0[part]), pack_array(h1[part]))

    def group(shard, owners, payloads):
        keys = [unpack_parts(p) for p in payloads]
        h0 = [unpack_sorted(k) for k, _ in keys]
        sizes = [len(h) for h in h0]
        h0, h1 = np.concatenate(h0), np.concatenate([unpack_array(k, np.uint64) for _, k in keys])
        order = np.lexsort((h1, h0))  # stable: equal windows stay in the order of chunks
        new = np.ones(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        new[1:] = (h0[a] != h0[b]) | (h1[a] != h1[b])
        again = earlier_group(order, new, np.repeat(groups[owners], sizes))
        for chunk, bits_ in zip(owners, np.split(again, np.cumsum(sizes)[:-1])):
            yield chunk, pack_bits(bits_)

    schema = docs.schema if replace else T.StructType([
        T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def remove(chunk, table, got):
        w = _Windows(table, text, size)
        some = np.flatnonzero(suspected(w, got)) if got else np.empty(0, np.int64)
        earlier = np.zeros(len(w.h0), dtype=bool)
        for s, part in _by_shard(w.h0[some], 64, shard_bits):
            earlier[some[part]] = unpack_bits(got["exact"][s], part.stop - part.start)
        goes = np.zeros(len(w.words), dtype=bool)
        if len(w.first):
            ids = np.repeat(ids_of(table.column(doc_id)), w.words.counts)[w.first]
            least = np.minimum.reduceat(ids[w.order], w.at)
            again = np.repeat(earlier, w.counts) | (ids[w.order] > np.repeat(least, w.counts))
            goes = covered(len(w.words), w.first[w.order][again], size)
        lost = per_text(goes, w.words.offsets)
        off = w.words.offsets

        def kept(i):
            have = w.texts.bytes(i).split()
            if lost[i]:
                have = [x for x, g in zip(have, goes[off[i]:off[i + 1]].tolist()) if not g]
            return b" ".join(have).decode()
        if replace:
            old = table.column(text).to_pylist()
            new = [kept(i) if lost[i] else old[i] for i in range(len(old))]
            at = table.schema.get_field_index(text)
            return table.set_column(at, table.schema.field(at), pa.array(new, table.schema.field(at).type)).cast(arrow)
        return pa.table([table.column(doc_id), pa.array(w.words.counts, pa.int64()), pa.array(lost, pa.int64()),
                         pa.array([kept(i) for i in range(len(lost))], pa.string())], schema=arrow)

    if chunks.count == 1:  # nothing to exchange
        return chunks.finish(remove, arrow, schema, None)
    prefilter = answer(chunks.emit(sketch), "sketch", merge)
    grouped = answer(chunks.emit(exact, prefilter), "exact", group)
    return chunks.finish(remove, arrow, schema, prefilter.unionByName(grouped))
