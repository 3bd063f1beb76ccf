"""Language-model scores: a hierarchical Pitman-Yor model of word pairs.

Every word seen in training is a context with a restaurant of its own; all of
them share one parent, and the parent's base is uniform over the training
words and one unknown word. A customer of a context is a token that follows
it, its dish the token; a table of a context is a customer of the parent.
With c customers and t tables of a dish, and C and T of a restaurant,

    P(dish) = (c - d t) / (s + C) + (s + d T) / (s + C) * P_parent(dish),

discount d estimated from how many dishes have one or two customers.

Seating is sampled in Gibbs sweeps. A sweep seats the customers of every pair
of words in turn, given the context's tables and the parent's probabilities
of the sweep before, then the parent's customers given the new tables. Pairs
are seated where they are: the documents' chunks know a pair's customers from
one exchange of counts, and draw random numbers by hashing the pair, so all
chunks with a pair seat it alike and its first chunk reports its tables. Only
sums for each word are exchanged in a sweep. Scores average the predictive
probabilities of the last sweeps.

Counts cover all training documents. Words are identified by 64-bit hashes,
pairs by as many bits as leave about one in a million with another's.

Defined results: a null or empty text is the end token alone; rows are
documents of their own even where ids repeat; a row with a null id is not
held out; extra columns are not read; with no training document every token
is unknown.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import Texts, Words, mix, per_text, word_hash
from .chunks import (Chunks, answer, forget_shuffles, pack_array, pack_bits, pack_parts, pack_sorted, unpack_array,
                     unpack_bits, unpack_parts, unpack_sorted)

END = mix(np.array([0x656E64], dtype=np.uint64))[0]  # the end token; it also stands before the first word
STRENGTH = 1.0  # s of every restaurant
ONE_BY_ONE = 64  # customers of a dish that are seated singly; further ones in blocks
STATS = -1  # the chunk number of the shards' totals


def held_out(ids: list, modulus: int, remainder: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids], dtype=bool)


def seat(key: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of dishes with so many customers, seated in turn.

    ``new`` is the weight of a new table, (s + d T) * P_parent(dish). Beyond
    ``ONE_BY_ONE`` customers come in blocks of a sixteenth of those seated;
    a block opens its expected number of tables, rounded at random.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seed = mix(np.array([sweep], dtype=np.uint64))
    # most customers first, so that those still seating are the first ``m``
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order])]
    c, k, new, t = customers[order], key[order] + seed, new[order], np.ones(len(order))
    seated, m = 1, len(order)
    while m:
        block = 1 if seated < ONE_BY_ONE else seated // 16
        draw = (mix(k[:m] + np.uint64(seated)) >> np.uint64(11)) * 2.0 ** -53
        if block == 1:
            t[:m] += np.floor(new[:m] / (new[:m] + seated - discount * t[:m]) + draw)
        else:
            come = np.minimum(c[:m] - seated, block)
            t[:m] += np.floor(come * (new[:m] / (new[:m] + seated + (come - 1) / 2 - discount * t[:m])) + draw)
        seated += block
        m = int(np.searchsorted(-c, -seated))
    tables[order] = t
    return np.minimum(tables, customers)


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where one of each is, and each key's number among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class _Tokens:
    """A chunk's tokens as numbers of its distinct words and pairs."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, modulus: int, remainder: int, bits: int = 64):
        self.column = table.column(doc_id)
        self.held_out = held_out(self.column.to_pylist(), modulus, remainder)
        texts = Texts.of(table.column(text))
        words = Words(texts)
        n = len(texts)
        self.offsets = words.offsets + np.arange(n + 1)
        doc = np.repeat(np.arange(n), words.counts)
        token = np.full(len(words) + n, END, dtype=np.uint64)
        token[np.arange(len(words)) + doc] = word_hash(texts, words, lower=True)
        self.words, _, self.token = _distinct(token)
        end = np.searchsorted(self.words, END)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.offsets[:-1]] = end
        left, right = self.words * np.uint64(0x9E3779B97F4A7C15), mix(self.words ^ np.uint64(0x5555))
        both = mix(left[self.context] + right[self.token])
        self.pairs, first, self.pair = _distinct(both & ~np.uint64((1 << (64 - bits)) - 1))
        self.left, self.right = self.context[first], self.token[first]
        self.training = np.repeat(~self.held_out, np.diff(self.offsets))

    def counts(self, number: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(number[self.training], minlength=n)


def _parts(keys: np.ndarray, shards: int):
    """(shard, slice) of sorted 64-bit keys by value."""
    step = (1 << 64) // shards
    edges = np.searchsorted(keys, np.array([i * step for i in range(1, shards)], dtype=np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]


def _joined(keys: np.ndarray, got: dict, shards: int, base: int, columns: int) -> list[np.ndarray]:
    """The answers' columns for all of a chunk's keys."""
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
    for s, part in _parts(keys, shards):
        for column, packed in zip(out, unpack_parts(got[base + s])):
            column[part] = unpack_array(packed, np.int64)
    return out


class _Model:
    """What a chunk knows of the seating, sweep by sweep."""

    def __init__(self, tokens: _Tokens, got: dict, shards: int, sweeps: list[dict], totals: dict):
        self.k, self.totals, self.sweeps = tokens, totals, sweeps
        self.count, = _joined(tokens.words, got["counts"], shards, 0, 1)
        pairs, owner = _joined(tokens.pairs, got["counts"], shards, shards, 2)
        self.customers, self.owner = pairs, owner.astype(bool)
        self.known = {i: _joined(tokens.words, got[f"sweep{i}"], shards, 0, 3)
                      for i in range(len(sweeps)) if f"sweep{i}" in got}

    def state(self, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Before a sweep: tables of each word's restaurant, and the parent's probabilities."""
        t = self.totals
        if sweep == 0:
            return self.count ** t["discount"], (self.count + 1) / (t["tokens"] + t["words"] + 1)
        tables, customers, own = self.known[sweep - 1]
        s = self.sweeps[sweep - 1]
        return tables, ((customers - s["discount"] * own) + (STRENGTH + s["discount"] * s["tables"]) / (t["words"] + 1)
                        ) / (STRENGTH + s["customers"])

    def seats(self, sweep: int, owned: bool = False) -> np.ndarray:
        """Tables of each of the chunk's pairs in a sweep (none, where another chunk reports it, if ``owned``)."""
        k, d = self.k, self.totals["discount"]
        tables, parent = self.state(sweep)
        new = (STRENGTH + d * tables[k.left]) * parent[k.right]
        if not owned:
            return seat(k.pairs, self.customers, new, d, sweep)
        mine = np.flatnonzero(self.owner)
        out = np.zeros(len(k.pairs))
        out[mine] = seat(k.pairs[mine], self.customers[mine], new[mine], d, sweep)
        return out

    def probabilities(self, sweep: int) -> np.ndarray:
        """Predictive probability of each of the chunk's pairs after a sweep."""
        k, d = self.k, self.totals["discount"]
        own = self.seats(sweep)
        tables, parent = self.state(sweep + 1)
        c = self.count[k.left]
        return ((self.customers - d * own) + (STRENGTH + d * tables[k.left]) * parent[k.right]) / (STRENGTH + c)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, doc_id: str = "doc_id", text: str = "text",
          burn_in: int = 1, samples: int = 2, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Documents whose crc32(id) modulo ``modulus`` is ``remainder`` are scored
    but not learned from. ``base_score`` is add-one smoothing of word counts.
    """
    spark = docs.sparkSession
    chunks = Chunks(docs.select(doc_id, text), doc_id, text, chunk_bytes)
    shards = int(max(2, chunks.n_bytes >> 25))  # 32 MB of text each: a message is large enough to be worth its own

    # pairs travel in so many leading bits that about one in a million meets another
    bits = min(64, int(np.ceil(np.log2(max(2, chunks.n_bytes)))) + 18)

    def tokens(table):
        return _Tokens(table, doc_id, text, modulus, remainder, bits)

    def count(chunk, table, _):
        k = tokens(table)
        for base, keys, number in ((0, k.words, k.token), (shards, k.pairs, k.pair)):
            n = k.counts(number, len(keys))
            for s, part in _parts(keys, shards):
                short = keys[part] >> np.uint64(64 - bits) if base else keys[part]
                yield base + s, pack_parts(pack_sorted(short), pack_array(n[part]))

    def add(shard, owners, payloads):
        parts = [unpack_parts(p) for p in payloads]
        keys = [unpack_sorted(p[0]) for p in parts]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        n = np.concatenate([unpack_array(p[1], np.int64) for p in parts])
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, n, len(distinct)).astype(np.int64)
        out = [total[inverse]]
        if shard >= shards:  # pairs: the first chunk that has one reports it
            owner = np.zeros(len(inverse), dtype=np.int64)
            owner[first] = 1
            out.append(owner)
            stats = [0, 0, int((total == 1).sum()), int((total == 2).sum())]
        else:
            stats = [int(total.sum()), int((total > 0).sum()), 0, 0]
        yield STATS, np.array(stats, dtype=np.int64).tobytes()
        for chunk, *columns in zip(owners, *(np.split(c, cuts) for c in out)):
            yield chunk, pack_parts(*map(pack_array, columns))

    def stats(answers: DataFrame) -> np.ndarray:
        rows = answers.where(F.col("chunk") == STATS).select("payload").collect()  # one for each shard
        return sum((np.frombuffer(r["payload"], np.int64) for r in rows), np.zeros(4, np.int64))

    counted = answer(chunks.emit(count), "counts", add)
    forget_shuffles(spark)
    found = stats(counted)
    totals = {"tokens": int(found[0]), "words": int(found[1]), "discount": discount(int(found[2]), int(found[3]))}
    sweeps: list[dict] = []
    answers = swept = counted
    for number in range(burn_in + samples):
        before = list(sweeps)
        guess = before[-1] if before else {"tables": totals["words"], "discount": 0.5}

        def seating(chunk, table, got, before=before, number=number):
            k = tokens(table)
            model = _Model(k, got, shards, before, totals)
            mine = model.seats(number, owned=True)
            of_context, of_word = (np.bincount(x, mine, len(k.words)).astype(np.int64) for x in (k.left, k.right))
            for s, part in _parts(k.words, shards):
                yield s, pack_parts(pack_sorted(k.words[part]), pack_array(of_context[part]), pack_array(of_word[part]))

        def parent(shard, owners, payloads, guess=guess, number=number):
            parts = [unpack_parts(p) for p in payloads]
            keys = [unpack_sorted(p[0]) for p in parts]
            cuts = np.cumsum([len(x) for x in keys])[:-1]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            of_context, of_word = (np.bincount(inverse, np.concatenate([unpack_array(p[i], np.int64) for p in parts]),
                                               len(distinct)).astype(np.int64) for i in (1, 2))
            new = np.full(len(distinct), (STRENGTH + guess["discount"] * guess["tables"]) / (totals["words"] + 1))
            own = seat(distinct, of_word, new, guess["discount"], number + 1000).astype(np.int64)
            yield STATS, np.array([of_word.sum(), own.sum(), (of_word == 1).sum(), (of_word == 2).sum()], np.int64).tobytes()
            for chunk, *columns in zip(owners, *(np.split(c[inverse], cuts) for c in (of_context, of_word, own))):
                yield chunk, pack_parts(*map(pack_array, columns))

        answers = answers.unionByName(swept) if number else counted
        swept = answer(chunks.emit(seating, counted.unionByName(swept) if number else counted), f"sweep{number}", parent)
        forget_shuffles(spark)
        found = stats(swept)
        sweeps.append({"customers": int(found[0]), "tables": int(found[1]),
                       "discount": discount(int(found[2]), int(found[3]))})
    answers = answers.unionByName(swept)

    schema = T.StructType([docs.schema[doc_id], T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])
    arrow = to_arrow_schema(schema)

    def total(chunk, table, got):
        k = tokens(table)
        model = _Model(k, got, shards, sweeps, totals)
        p = np.mean([model.probabilities(i) for i in range(burn_in, burn_in + samples)], axis=0)
        count = model.count[k.token]
        base = np.log10((count + 1) / (totals["tokens"] + totals["words"] + 1))
        sums = [np.add.reduceat(x, k.offsets[:-1]) for x in (base, np.log10(p)[k.pair])]
        return pa.table([k.column, pa.array(k.held_out), pa.array(np.diff(k.offsets)), pa.array(per_text(count > 0, k.offsets)),
                         pa.array(np.full(len(k.held_out), totals["tokens"])), *map(pa.array, sums)], schema=arrow)
    return chunks.finish(total, arrow, schema, answers)
