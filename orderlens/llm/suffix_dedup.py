"""Suffix-array dedup: suffixes in buckets, thinned by a difference cover.

A byte goes if some string of ``size`` bytes that covers it also starts in a
document with a smaller id. Strings are suffixes cut at ``size`` bytes; equal
ones are neighbours in the sorted order of all suffixes, which is built one
bucket (a range of that order) at a time, so that memory and disk hold one
bucket, not all suffixes.

Cover sample: positions of a document modulo ``PERIOD`` that lie in a
difference cover. For any two positions some shift below ``PERIOD`` takes
both into the sample, so two equal strings share an equal sample string of
``size - PERIOD + 1`` bytes at one and the same shift. Sample strings are
sorted first, and each chunk learns which of its own occur again. A suffix
without such a sample in reach is unlike all others and takes no further
part; this is what the cover's ranks decide here. Bucket by bucket, the
others are sorted by their first four bytes; longer ties fall to a 64-bit
hash of the whole string instead of to ranks at the pair's common shift,
because that shift differs from pair to pair, while a hash orders a bucket
at once, wherever its suffixes are. Strings are equal if eight literal bytes
and the hash are.

Defined results: a null text has no bytes; rows with equal ids are one
document (they don't remove each other's bytes); null ids sort before all
others; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import Texts, distinct, hash_at, per_text
from .chunks import (Chunks, answer, earlier_group, forget_shuffles, ids_of, pack_array, pack_bits, pack_parts, pack_sorted,
                     unpack_array, unpack_bits, unpack_parts, unpack_sorted)

# fixed values: a perfect difference cover; the differences of COVER are all residues modulo PERIOD
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
PREFIX = 4  # bytes by which a bucket is sorted first


class _Bytes:
    """The texts of a chunk in an order that depends on its rows alone."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        table = table.select([doc_id, text]).sort_by([(doc_id, "ascending"), (text, "ascending")])
        self.column = table.column(doc_id)
        self.texts = Texts.of(table.column(text))
        self.ids = ids_of(self.column)
        self.data, self.offsets = self.texts.data, self.texts.offsets

    def starting(self, size: int, pattern: np.ndarray | None = None) -> np.ndarray:
        """Whether ``size`` bytes of one text start at each byte, and the
        byte's place in the text modulo PERIOD is in the pattern."""
        longest = int(np.diff(self.offsets).max(initial=0))
        row = np.ones(longest, dtype=bool) if pattern is None else np.resize(pattern, longest)
        out = np.zeros(len(self.data), dtype=bool)
        for start, n in zip(self.offsets[:-1].tolist(), (np.diff(self.offsets) - size + 1).tolist()):
            if n > 0:
                out[start:start + n] = row[:n]
        return out

    def samples(self, size: int) -> np.ndarray:
        """Positions of the cover sample with ``size`` bytes left in their text."""
        pattern = np.zeros(PERIOD, dtype=bool)
        pattern[list(COVER)] = True
        return np.flatnonzero(self.starting(size, pattern))

    def near(self, found: np.ndarray, size: int) -> np.ndarray:
        """Which strings of ``size`` bytes have one of the samples ``found`` at a shift below PERIOD."""
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        first = found - PERIOD + 1
        edge[0] = np.count_nonzero(first < 0)
        edge[first[first >= 0]] += 1
        edge[found + 1] -= 1
        return (np.cumsum(edge[:-1]) > 0) & self.starting(size)

    def prefixes(self, at: np.ndarray, skip: int = 0) -> np.ndarray:
        """PREFIX bytes at each position, as a number that sorts like them."""
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(skip, skip + PREFIX):
            out = out << np.uint64(8) | self.data[at + k].astype(np.uint64)
        return out

    def keys(self, at: np.ndarray, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each string: four bytes and half its hash, then the
        next four bytes and the other half."""
        tail, low = hash_at(self.data, at, size), np.uint64(0xFFFFFFFF)
        return prefix << np.uint64(32) | tail >> np.uint64(32), self.prefixes(at, PREFIX) << np.uint64(32) | tail & low


def _among(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), dtype=bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def _ordered(major: np.ndarray, minor: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by both numbers, and which strings in it differ from the one before.

    Equal major numbers almost always mean equal strings, so one sort does;
    the few runs in which minor numbers differ are sorted again."""
    order = np.argsort(major, kind=kind)
    a, b = major[order], minor[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    mixed = np.flatnonzero(~new[1:] & (b[1:] != b[:-1])) + 1
    if len(mixed):
        starts = np.append(np.flatnonzero(new), len(order))
        for run in np.unique(np.searchsorted(starts, mixed, "right")):
            part = slice(int(starts[run - 1]), int(starts[run]))
            order[part] = order[part][np.argsort(b[part], kind="stable")]
        b = minor[order]
        new[1:] |= b[1:] != b[:-1]
    return order, new


class _Suffixes:
    """Distinct strings at some positions, in suffix order."""

    def __init__(self, texts: _Bytes, at: np.ndarray, prefix: np.ndarray, size: int):
        major, minor = texts.keys(at, prefix, size)
        order, new = _ordered(major, minor)
        self.first = np.flatnonzero(new)
        self.at = at[order]
        self.major, self.minor = major[order[self.first]], minor[order[self.first]]
        self.counts = np.diff(self.first, append=len(order))

    def parts(self, cuts: list[int]) -> list[slice]:
        """The ranges of strings between the cuts."""
        edges = [0, *np.searchsorted(self.major, np.array(cuts, dtype=np.uint64)).tolist(), len(self.major)]
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _cuts(chunks: Chunks, doc_id: str, text: str, size: int, parts: int, sample: int = 20_000) -> list[int]:
    """parts - 1 major numbers that divide the suffix order evenly, from a bounded sample."""
    each = max(1, sample // chunks.count)

    def some(chunk, table, _):
        b = _Bytes(table, doc_id, text)
        at = b.samples(size)
        at = at[:: max(1, len(at) // each)][:each]
        return [(int(chunk), int(k)) for k in b.keys(at, b.prefixes(at), size)[0].view(np.int64)]
    schema = pa.schema([("chunk", pa.int64()), ("major", pa.int64())])
    found = sorted(r["major"] % 2**64 for r in chunks.finish(some, schema, "chunk long, major long", None).collect())
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50,
                   chunk_bytes: int = 4 << 20, buckets: int = 6, shards: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` has the bytes that stay."""
    if size < PERIOD + 2 * PREFIX:
        raise ValueError(f"strings must have {PERIOD + 2 * PREFIX} bytes or more")
    spark = docs.sparkSession
    chunks = Chunks(docs.select(doc_id, text), doc_id, text, chunk_bytes)
    groups = chunks.groups
    short = size - PERIOD + 1
    # enough bits that few different sample strings look equal
    bits = min(64, max(32, int(np.ceil(np.log2(max(2, chunks.n_bytes)))) + 7))
    shards = shards or max(4, chunks.n_bytes >> 25)

    def names(b: _Bytes):
        at = b.samples(short)
        return at, hash_at(b.data, at, short, 1) >> np.uint64(64 - bits)

    def pieces(key):
        step = -(-(1 << bits) // shards)
        edges = np.searchsorted(key, np.array([min(i * step, (1 << bits) - 1) for i in range(1, shards)], dtype=np.uint64))
        edges = [0, *edges.tolist(), len(key)]
        return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]

    def sample(chunk, table, _):
        key = distinct(names(_Bytes(table, doc_id, text))[1])
        for s, part in pieces(key):
            yield s, pack_sorted(key[part])

    def again(shard, owners, payloads):
        keys = [unpack_sorted(p) for p in payloads]
        every = np.sort(np.concatenate(keys))
        twice = distinct(every[1:][every[1:] == every[:-1]])  # a chunk has each key once
        for chunk, key in zip(owners, keys):
            yield chunk, pack_bits(_among(key, twice))

    def mark(chunk, table, got):
        """The strings that take part, as a bit for each byte."""
        b = _Bytes(table, doc_id, text)
        at, name = names(b)
        order = np.argsort(name)
        name = name[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = name[1:] != name[:-1]
        first = np.flatnonzero(new)
        some = np.diff(first, append=len(name)) > 1  # again in this chunk
        for s, part in pieces(name[first]) if got else []:
            some[part] |= unpack_bits(got["again"][s], part.stop - part.start)
        found = np.sort(at[order[np.repeat(some, np.diff(first, append=len(name)))]])
        return [(int(chunk), "taking", 0, pack_bits(b.near(found, size)))]

    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("shard", pa.int64()), ("payload", pa.binary())])
    columns = "chunk long, kind string, shard long, payload binary"
    one = chunks.count == 1  # nothing to exchange
    repeated = None if one else answer(chunks.emit(sample), "again", again)
    answers = materialize(chunks.finish(mark, schema, columns, repeated))
    del repeated
    cuts = [] if one else _cuts(chunks, doc_id, text, size, buckets * shards)

    def solve(shard, owners, payloads):
        """In an earlier group of chunks or not, for each string of each chunk."""
        keys = [unpack_parts(p) for p in payloads]
        major = [unpack_sorted(p) for p, _ in keys]
        sizes = [len(p) for p in major]
        order, new = _ordered(np.concatenate(major), np.concatenate([unpack_array(t, np.uint64) for _, t in keys]), "stable")
        earlier = earlier_group(order, new, np.repeat(groups[owners], sizes))  # equal strings stay in the order of chunks
        for chunk, found in zip(owners, np.split(earlier, np.cumsum(sizes)[:-1])):
            yield chunk, pack_bits(found)

    def bucket(number):
        lo, hi = number * shards, (number + 1) * shards
        least, most = (cuts[lo - 1] if lo else 0) >> 32, (cuts[hi - 1] if hi <= len(cuts) else 2**64 - 1) >> 32

        def emit(chunk, table, got):
            b = _Bytes(table, doc_id, text)
            at = np.flatnonzero(unpack_bits(got["taking"][0], len(b.data)))
            prefix = b.prefixes(at)
            inside = (prefix >= np.uint64(least)) & (prefix <= np.uint64(most))
            found = _Suffixes(b, at[inside], prefix[inside], size)
            for s, part in enumerate(found.parts(cuts)):
                if lo <= s < hi and part.start < part.stop:
                    yield s, pack_parts(pack_sorted(found.major[part]), pack_array(found.minor[part]))
        return emit

    if cuts:
        taking = answers
        for number in range(buckets):
            forget_shuffles(spark)
            answers = answers.unionByName(answer(chunks.emit(bucket(number), taking), "earlier", solve))

    result = T.StructType([docs.schema[doc_id], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(result)

    def remove(chunk, table, got):
        b = _Bytes(table, doc_id, text)
        at = np.flatnonzero(unpack_bits(got["taking"][0], len(b.data)))
        found = _Suffixes(b, at, b.prefixes(at), size)
        earlier = np.zeros(len(found.major), dtype=bool)
        for s, part in enumerate(found.parts(cuts)) if cuts else []:
            if part.start < part.stop:
                earlier[part] = unpack_bits(got["earlier"][s], part.stop - part.start)
        gone = np.zeros(len(b.data), dtype=bool)
        if len(at):
            ids = np.repeat(b.ids, np.diff(b.offsets))[found.at]
            least = np.minimum.reduceat(ids, found.first)
            goes = np.repeat(earlier, found.counts) | (ids > np.repeat(least, found.counts))
            edge = np.zeros(len(b.data) + 1, dtype=np.int32)
            start = found.at[goes]
            edge[start] += 1
            edge[start + size] -= 1
            gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = b.offsets[:-1][b.offsets[:-1] < b.offsets[1:]]
        begins[heads] = gone[heads]
        kept_bytes = per_text(~gone, b.offsets)
        kept = b.data[~gone]
        ends = np.concatenate(([0], np.cumsum(kept_bytes))).tolist()
        return pa.table([b.column, pa.array(np.diff(b.offsets)), pa.array(per_text(gone, b.offsets)),
                         pa.array(per_text(begins, b.offsets)),
                         pa.array([kept[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())], schema=arrow)

    forget_shuffles(spark)
    return chunks.finish(remove, arrow, result, answers)
