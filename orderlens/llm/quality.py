"""Quality rules: tokeniser fertility within limits for each language.

Every text gets counts of words, lines and repeats, and is tokenised word by
word with a public vocabulary that falls back to bytes. Three measures tell
how well the text fits that vocabulary: characters per token, the share of
byte tokens, and the entropy of its tokens (in bits, divided by the entropy
of as many different ones). That entropy falls with a text's length, so it is
judged by its distance from the line that all documents of the same band give
over the logarithm of their tokens. Each measure has one limit, on the side
where texts don't fit: few characters per token, many byte tokens, little
entropy for the length. It lies a number of quartile distances (and at least
``SLACK``) beyond the quartile on that side; quartiles are taken for every
language from all documents that pass the base rules, by exact counts of the
rounded measures. A text beyond a limit of its language is rejected.

Limits are kept for the languages named in ``languages`` and, for all others,
for the script that most letters of the text belong to, so their number is
bounded whatever the column holds.

Defined results: a null or empty text has no words and fails the base rules;
a document with fewer than ``MIN_TOKENS`` tokens is not judged by limits, nor
is a group of fewer than ``MIN_GROUP`` documents; rows are judged each for
itself, so repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import IS_BLANK, Texts, Words, covered, per_text, span_hash, text_slices, windows, word_hash

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
MIN_TOKENS, MIN_GROUP = 50, 30
MEASURES = ("chars_per_token", "byte_share", "entropy")
STEPS = (0.01, 0.001, 0.001)  # to which the measures are rounded
SIDES = (-1, 1, -1)  # limits lie at the low (-1) or the high end
SLACK = (0.1, 0.02, 0.03)  # least distance of a limit from the quartile
MOST = 5000  # steps; a measure further from 0 counts as this
# fixed values: the symbols that the contract counts
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
# lead bytes of two- and three-byte sequences by script, as far as they tell it
_SCRIPTS = {"latin": (0x41, 0xC9), "greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "hebrew": (0xD6, 0xD7),
            "arabic": (0xD8, 0xDB), "indic": (0xE0, 0xE0), "cjk": (0xE3, 0xED)}


class _Pieces:
    """Ids of a sentencepiece vocabulary by word, kept by word."""

    def __init__(self, path: str, cache_words: int = 400_000):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.size, self.known, self.cache_words = size, {}, cache_words

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        if len(self.known) > self.cache_words:
            self.known.clear()
        known = self.known
        new = list({w for s in split for w in s if w not in known})
        for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            known[w] = np.array(ids, dtype=np.uint32).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), np.uint32) for s in split]


@functools.cache
def _pieces(path: str) -> _Pieces:
    """Loaded once in each Python worker."""
    return _Pieces(path)


def _script(texts: Texts) -> list[str]:
    """The script to which most letters of each text belong."""
    counts = []
    for low, high in _SCRIPTS.values():
        lead = (texts.data >= low) & (texts.data <= high)
        if low == 0x41:
            lead &= (texts.data <= 0x7A) | (texts.data >= 0xC3)
        counts.append(per_text(lead, texts.offsets))
    best = np.argmax(counts, axis=0)
    names = list(_SCRIPTS)
    return [names[i] for i in best]


def _entropy(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Entropy of each text's ids, divided by that of as many different ids."""
    n = np.array([len(x) for x in ids])
    if n.sum() == 0:
        return np.zeros(len(ids))
    key = np.sort(np.repeat(np.arange(len(ids)), n) * size + np.concatenate(ids))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(first, append=len(key))
    total = np.bincount(key[first] // size, count * np.log2(count), len(ids))
    most = np.log2(np.maximum(n, 2))
    return np.where(n > 1, (most - total / np.maximum(n, 1)) / most, 0.0)


def measures(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             languages: tuple[str, ...] = LANGUAGES, window: int = 8) -> DataFrame:
    """(doc_id, band, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, and the measures)."""
    docs = docs.select(doc_id, text, lang)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
    schema = T.StructType([docs.schema[doc_id], T.StructField("band", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in counts),
                           *(T.StructField(m, T.DoubleType()) for m in MEASURES)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in text_slices(batches, text, 2 << 20):
            texts = Texts.of(b.column(1))
            words = Words(texts)
            chars = per_text(~IS_BLANK[texts.data] & ((texts.data & 0xC0) != 0x80), texts.offsets)
            first = windows(words, window)
            h = span_hash(word_hash(texts, words), first, first + window)
            doc = np.repeat(np.arange(len(texts)), words.counts)[first]
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(order), dtype=bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            repeated = covered(len(words), first[twice], window)
            raw = [texts.bytes(i) for i in range(len(texts))]
            again = []
            for t in raw:
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                again.append(len(lines) - len(set(lines)))
            ids = pieces.ids(raw)
            n = np.array([len(x) for x in ids], dtype=np.int64)
            fallback = np.array([pieces.is_byte[x].sum() for x in ids], dtype=np.int64)
            known = [x if x in languages else None for x in b.column(2).to_pylist()]
            band = [x or s for x, s in zip(known, _script(texts))]
            least = np.maximum(n, 1)
            columns = [b.column(0), pa.array(band), *(pa.array(np.asarray(x, np.int64)) for x in (
                words.counts, chars, per_text(SYMBOLS[texts.data], texts.offsets), again,
                per_text(repeated, words.offsets), n)),
                *(pa.array(x) for x in (chars / least, fallback / least, _entropy(ids, pieces.size)))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
    return docs.mapInArrow(run, schema)


def _over_length(measured: DataFrame, judged: Column) -> DataFrame:
    """``measured`` with ``_expected``: the entropy that its band's documents have at its length."""
    x = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
    mine = measured.where(judged).select("band", x.alias("x"), "entropy")
    slope = F.coalesce(F.covar_pop("x", "entropy") / F.nullif(F.var_pop("x"), F.lit(0.0)), F.lit(0.0))
    lines = mine.groupBy("band").agg(slope.alias("slope"), F.avg("x").alias("x"), F.avg("entropy").alias("y"))
    # rounded, so that the order of additions doesn't decide; a row for each named language or script
    lines = lines.select("band", F.round("slope", 6).alias("_slope"),
                         F.round(F.col("y") - F.round("slope", 6) * F.col("x"), 6).alias("_start"))
    out = measured.join(F.broadcast(lines), "band", "left")
    return out.withColumn("_expected", F.col("_start") + F.col("_slope") * x).drop("_start", "_slope")


def _steps() -> list[Column]:
    """The measures as judged, in whole steps."""
    judged = (F.col(MEASURES[0]), F.col(MEASURES[1]), F.col(MEASURES[2]) - F.col("_expected"))
    return [F.greatest(F.least(F.round(m / s).cast("long"), F.lit(MOST)), F.lit(-MOST)) for m, s in zip(judged, STEPS)]


def limits(judged: DataFrame, distances: float) -> DataFrame:
    """(band, and the limit of each measure in steps): a row for each band."""
    each = judged.select("band", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), x.alias("step"))
                                                     for m, x in zip(MEASURES, _steps())))).alias("x"))
    counts = each.groupBy("band", "x.measure", "x.step").agg(F.count(F.lit(1)).alias("n"))
    # from here on at most 2 * MOST rows for each measure of each band
    whole = Window.partitionBy("band", "measure")
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
    quartile = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) for q in (0.25, 0.75)]
    ends = counts.where(F.col("all") >= MIN_GROUP).groupBy("band", "measure").agg(
        quartile[0].alias("low"), quartile[1].alias("high"))
    out = []
    for m, step, side, slack in zip(MEASURES, STEPS, SIDES, SLACK):
        reach = F.greatest((F.col("high") - F.col("low")) * distances, F.lit(round(slack / step)))
        end = F.col("low") - reach if side < 0 else F.col("high") + reach
        out.append(F.max(F.when(F.col("measure") == m, end)).alias(f"_{m}"))
    return ends.groupBy("band").agg(*out)


def judge(measured: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, distances: float = 3.0) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: the base rules, then the limits from all documents."""
    measured = materialize(measured.withColumn("base_failed", (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))))
    judged = ~F.col("base_failed") & (F.col("n_tokens") >= MIN_TOKENS)
    whole = _over_length(measured, judged)
    # a row for each named language or script: a fixed number
    out = whole.join(F.broadcast(limits(whole.where(judged), distances)), "band", "left")
    beyond = F.lit(False)
    for m, x, side in zip(MEASURES, _steps(), SIDES):
        beyond |= F.coalesce(x < F.col(f"_{m}") if side < 0 else x > F.col(f"_{m}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~(judged & beyond)).select(*measured.columns, "kept")
