"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes of its words, word pairs and word
pairs with one word between (words: runs of ASCII letters and digits and of
bytes beyond ASCII, A-Z as a-z), and of its words' first letters, as compound
words share these. The model is fitted online, one document
after the other in hash order, with a learning rate for every coordinate; L1
leaves few weights, which travel with the scoring job.

Labelled rows are used up to ``max_rows``, those with the smallest hashes of
their id; this is the only bound. All documents are scored, whole.

Defined results: null and empty texts score by the intercept alone; labels
that are null or without a document are not used; several labels of one id
count as toxic if any is; with no labelled row every score is 0.5; rows are
scored independently, so repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import Texts, Words, distinct, mix, ranges, text_slices, word_hash

_WORD_BREAK = np.ones(256, dtype=bool)
_WORD_BREAK[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD_BREAK[ord(_a):ord(_b) + 1] = False
PREFIXES = (3, 5, 7)  # numbers of first letters that are features


@dataclass(frozen=True)
class Weights:
    """The weights that aren't zero, by feature number, and the intercept."""

    bits: int
    features: np.ndarray
    values: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.features] = self.values
        return out


def features(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of all n-grams, repeats included."""
    words = Words(texts, _WORD_BREAK)
    h = word_hash(texts, words, lower=True)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    rows, grams = [doc], [mix(h)]
    for gap in (1, 2):
        n = np.maximum(words.counts - gap, 0)
        first = ranges(words.offsets[:-1], n)
        rows.append(doc[first])
        grams.append(mix(h[first] * np.uint64(2 * gap + 1) + mix(h[first + gap] + np.uint64(gap))))
    lead = np.append((texts.data & 0xC0) != 0x80, True)
    letter = np.flatnonzero(lead)  # where each code point begins
    at = np.searchsorted(letter, words.starts)
    for k in PREFIXES:
        stop = letter[np.minimum(at + k, len(letter) - 1)]
        long = np.flatnonzero(stop < words.ends)
        cut = Words.spans(words.starts[long], stop[long])
        rows.append(doc[long])
        grams.append(mix(word_hash(texts, cut, lower=True) + np.uint64(100 + k)))
    return np.concatenate(rows), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int, bits: int,
             doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(_order, label, grams): packed distinct features of at most ``max_rows`` labelled documents."""
    chosen = (labels.where(usable & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id)
              .agg(F.max(F.col(label).cast("int")).alias("_label")).withColumn("_order", F.xxhash64(doc_id))
              .orderBy("_order", doc_id).limit(max_rows))
    rows = docs.select(doc_id, F.col(text).alias("_text")).join(F.broadcast(chosen), doc_id).drop(doc_id)
    schema = T.StructType([T.StructField("_order", T.LongType()), T.StructField("label", T.IntegerType()),
                           T.StructField("grams", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "_text", 1 << 20):
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            doc, gram = features(Texts.of(column["_text"]), bits)
            both = distinct(doc << bits | gram)
            parts = np.split((both & ((1 << bits) - 1)).astype(np.uint32),
                             np.searchsorted(both >> bits, np.arange(1, b.num_rows)))
            yield pa.RecordBatch.from_arrays([column["_order"], column["_label"], pa.array(
                [x.tobytes() for x in parts], pa.binary())], schema=arrow)
    return rows.mapInArrow(run, schema)


def fit(sample: DataFrame, bits: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0,
        l2: float = 1.0) -> Weights:
    """FTRL-proximal over ``sample``, in the order of its hashes.

    The sample, bounded in rows by ``labelled``, is sorted once into one
    stored partition. One task streams through it ``epochs`` times and holds
    a batch of rows, however long their texts, and the state: two numbers for
    each of the 2**``bits`` coordinates. Only the weights that aren't zero
    reach the driver.
    """
    stored = materialize(sample.repartition(1).sortWithinPartitions("_order", "label", "grams"))
    stream = reduce(DataFrame.union, [stored] * epochs, stored.where(F.lit(False))).coalesce(1)
    size = (1 << bits) + 1  # the last one is the intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n, first = np.zeros(size), np.zeros(size), np.array([1 << bits])
        for b in batches:
            y_at, grams_at = (b.schema.get_field_index(c) for c in ("label", "grams"))
            for y, packed in zip(b.column(y_at).to_pylist(), b.column(grams_at)):
                at = np.concatenate((np.frombuffer(packed.as_buffer(), np.uint32).astype(np.int64), first))
                w = _weights(z, n, at, alpha, beta, l1, l2)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                root = np.sqrt(n[at])
                n[at] += g * g
                z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
        used = np.flatnonzero(n)
        w = _weights(z, n, used, alpha, beta, l1, l2)
        yield pa.RecordBatch.from_arrays([pa.array([x[w != 0].tobytes()], pa.binary()) for x in (used, w)],
                                         names=["features", "weights"])
    found = stream.mapInArrow(run, "features binary, weights binary").collect()  # at most one row
    at = np.frombuffer(found[0]["features"], np.int64) if found else np.zeros(0, np.int64)
    w = np.frombuffer(found[0]["weights"], np.float64) if found else np.zeros(0)
    own = at < 1 << bits
    return Weights(bits, at[own], w[own], float(w[~own].sum()))


def _weights(z: np.ndarray, n: np.ndarray, at: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of the coordinates ``at``; the intercept, the last one, is not thinned by ``l1``."""
    out = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return np.where((np.abs(z[at]) > l1) | (at == len(z) - 1), out, 0.0)


def score(docs: DataFrame, weights: Weights, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of the label as column ``into``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bits = weights.dense(), weights.bits
        for b in text_slices(batches, text, 1 << 20):
            doc, gram = features(Texts.of(b.column(b.schema.get_field_index(text))), bits)
            some = dense[gram] != 0
            both = distinct(doc[some] << bits | gram[some])
            total = weights.intercept + np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema=arrow)
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 16_000, bits: int = 20, **settings) -> Weights:
    """Weights from the documents' labels, where ``usable`` holds."""
    return fit(labelled(docs, labels, usable, max_rows, bits), bits, **settings)
