"""Packing documents into sequences, shortest pack first.

Every document is tokenised and cut into pieces of ``length`` ids and a rest.
The histogram of piece lengths (``length`` counts, whatever the corpus) is
packed on the driver: lengths from the longest down go to the packs with the
most room, whole groups of equal packs at a time, so that the result is a
list of patterns with counts. Pieces find their place by rank: the k-th piece
of a length takes the k-th place that the patterns have for it. Ranks come
from counts by (length, slice of the pieces), never from one sorted group.

Defined results: a null or empty text is its end id alone; rows are packed
independently, so repeated rows each get places; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import text_slices
from .bpe import byte_letters

SLICE_ROWS = 5_000  # pieces of one length that are ranked together, about


class _Encoder:
    """Word ids of a tokenizer that drops white space, kept by word.

    Such a tokenizer never joins letters across blanks, nor letters with
    closing marks, so a text's ids are its words' ids; each distinct word
    goes to the tokenizer once, without its case and closing marks where
    these are Latin-1 (there lower case is the same everywhere).
    """

    MARKS = ".,!?;:|"

    def __init__(self, path: str, cache_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.letters = {b: c for c, b in byte_letters().items()}

    def _look_up(self, stems: set[str], marks: set[str]) -> None:
        """Ids of lower-case Latin-1 words by the merges alone, which is all
        that is left to do for them; of everything else by the whole tokenizer."""
        if len(self.stems) > self.cache_words:
            self.stems.clear()
        tokenize = self.tokenizer.model.tokenize
        for s in stems:
            if s not in self.stems:
                letters = s.encode().decode("latin-1").translate(self.letters)
                self.stems[s] = array("I", [x.id for x in tokenize(letters)]).tobytes()
        new = [s for s in marks if s not in self.stems]
        for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.stems[s] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            # added tokens are looked for before the tokenizer changes the case
            if max(t, default="") <= "\xff" and "<|" not in t:
                t = t.lower()
            split.append(t.replace("\n", " ").split(" "))
        if len(self.known) > self.cache_words:
            self.known.clear()
        known = self.known
        parts = {}
        for w in {w for s in split for w in s if w not in known}:
            stem = w.rstrip(self.MARKS)
            plain = stem.isalpha() and max(stem) <= "\xff" and stem == stem.lower()
            parts[w] = (stem, w[len(stem):]) if plain else ("", w)
        self._look_up({s for s, _ in parts.values()}, {m for _, m in parts.values()})
        stems = self.stems
        for w, (stem, marks) in parts.items():
            known[w] = stems[stem] + stems[marks]
        return [b"".join(map(known.__getitem__, s)) for s in split]


@functools.cache
def _encoder(path: str, cache_words: int) -> _Encoder:
    """Loaded once in each Python worker."""
    return _Encoder(path, cache_words)


def cut(docs: DataFrame, path: str, end_id: int, length: int, doc_id: str = "doc_id", text: str = "text",
        with_ids: bool = False, cache_words: int = 600_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): pieces of at most ``length`` ids (``ids`` an array of int)."""
    docs = docs.select(doc_id, text)
    long = T.LongType()
    schema = T.StructType([docs.schema[doc_id], *(T.StructField(n, long) for n in (
        "start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    arrow = to_arrow_schema(schema)
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, cache_words)
        for b in text_slices(batches, text, 1 << 20):
            rows, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += last
                n = len(ids) // 4
                for at in range(0, n, length):
                    piece = ids[4 * at:4 * (at + length)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    if with_ids:
                        parts.append(piece)
            out = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (
                starts, lengths, crcs, totals))]
            if with_ids:
                values = np.frombuffer(b"".join(parts), dtype="<i4")
                at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values), type=arrow.field("ids").type))
            yield pa.RecordBatch.from_arrays(out, schema=arrow)
    return docs.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(piece length, times), ...]): packs of at most ``length``.

    Lengths go from the longest down; each goes to the packs with the most
    room, and new packs open only where none has room. Fuller packs come first.
    """
    groups: list[tuple[int, int, list]] = []  # (-room, number, [count, pattern])
    number, done = 0, []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and groups and -groups[0][0] >= size:
            room, _, (count, pattern) = heapq.heappop(groups)
            taken = min(count, left)
            if taken < count:
                number += 1
                heapq.heappush(groups, (room, number, (count - taken, pattern)))
            more = [*pattern[:-1], (size, pattern[-1][1] + 1)] if pattern[-1][0] == size else [*pattern, (size, 1)]
            number += 1
            heapq.heappush(groups, (room + size, number, (taken, more)))
            left -= taken
        times = length // size
        for count, t in ((left // times, times), (1 if left % times else 0, left % times)):
            if count:
                number += 1
                heapq.heappush(groups, (t * size - length, number, (count, [(size, t)])))
        while groups and groups[0][0] == 0:
            done.append(heapq.heappop(groups)[2])
    return sorted(done + [g[2] for g in groups], key=lambda g: (-sum(size * times for size, times in g[1]), g[1], g[0]))


def _ranked(pieces: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """``pieces`` with ``_rank``, their number from 0 among those of equal length."""
    slices = max(1, -(-n_rows // SLICE_ROWS))
    # equal rows are dealt by their number in the stored table
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order, "_row"), F.lit(slices)))
    counts = pieces.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order, "_row"))
    return (pieces.withColumn("_own", own).join(counts, ["length", "_slice"])
            .withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_slice", "_own", "_before", "_row"))


def pack(pieces: DataFrame, length: int, order: list[str]) -> DataFrame:
    """``pieces`` with their place: ``sequence_id`` and ``offset``.

    Only ``length`` and ``order`` are ranked and pass through Python; further
    columns, such as a piece's ids, meet their place by the row's number.
    """
    pieces = materialize(pieces)
    whole, narrow = pieces, list(dict.fromkeys(["length", *order]))
    apart = set(pieces.columns) - {*narrow, "doc_tokens"}
    if apart:
        whole = pieces.withColumn("_place", F.monotonically_increasing_id())
        pieces = whole.select(*narrow, "_place")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    first, at_sequence, places = dict.fromkeys(histogram, 0), 0, []
    for count, pattern in patterns(histogram, length):
        offset = 0
        for size, times in pattern:
            places.append((size, first[size], times, at_sequence, offset))
            first[size] += count * times
            offset += size * times
        at_sequence += count
    places.sort()
    table = np.array(places, dtype=np.int64).reshape(-1, 5)  # at most a few rows for each length and pack pattern

    ranked = _ranked(pieces, order, sum(histogram.values()))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    arrow, names = to_arrow_schema(schema), pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            size, rank = (np.asarray(b.column(b.schema.get_field_index(n))) for n in ("length", "_rank"))
            place = table[np.searchsorted(keys, size * (1 << 44) + rank, "right") - 1]
            k = rank - place[:, 1]
            sequence, offset = place[:, 3] + k // place[:, 2], place[:, 4] + k % place[:, 2] * size
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=arrow)
    placed = ranked.mapInArrow(run, schema)
    if not apart:
        return placed
    return (whole.join(placed.select("_place", "sequence_id", "offset"), "_place")
            .select(*(c for c in whole.columns if c != "_place"), "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False, cache_words: int = 600_000) -> DataFrame:
    """The pieces of all documents with their places.

    A Python worker keeps the ids of about ``cache_words`` words and as many stems (some 250 bytes each)."""
    pieces = cut(docs, path, end_id, length, doc_id, text, with_ids, cache_words)
    return pack(pieces, length, [doc_id, "start", "ids_crc32"])
