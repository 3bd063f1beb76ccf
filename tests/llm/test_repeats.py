"""Substring and suffix dedup, SimHash, embeddings and scores against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import embedding_dedup, pitman_yor, simhash, substring_dedup, suffix_dedup
from orderlens.llm.chunks import Chunks, pack_array, pack_parts
from orderlens.llm.queries import op2_embedding_dedup, op5_simhash, op7_suffix_dedup, op8_pitman_yor, op9_substring_dedup
from tests.conftest import SF_SMALL
from tests.llm.conftest import components, edge_texts, words


def order(i):
    return -1 if i is None else i


def docs_of(spark, sf=SF_SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").collect()]


def removed(texts, size, split):
    """For each row which units lie in a window that starts in a smaller document."""
    first = {}
    for i, t in texts:
        w = split(t)
        for k in range(len(w) - size + 1):
            at = w[k:k + size] if isinstance(w, bytes) else tuple(w[k:k + size])
            first[at] = min(first.get(at, math.inf), order(i))
    out = []
    for i, t in texts:
        w = split(t)
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1):
            if first[w[k:k + size] if isinstance(w, bytes) else tuple(w[k:k + size])] < order(i):
                gone[k:k + size] = b"\1" * size
        out.append((i, w, gone))
    return out


def plain_words(texts, size):
    return Counter((i, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode())
                   for i, w, g in removed(texts, size, lambda t: (t or "").encode().split()))


def plain_bytes(texts, size):
    return Counter((i, len(w), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])),
                    bytes(x for x, y in zip(w, g) if not y))
                   for i, w, g in removed(texts, size, lambda t: (t or "").encode()))


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 2000])
def test_repeated_words(edge, chunk_bytes):
    rows = substring_dedup.repeated_words(edge, chunk_bytes=chunk_bytes).collect()
    want = plain_words(edge_texts(), 50)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == want
    assert sum(k[2] * n for k, n in want.items()) > 300


def test_repeated_words_replaced_in_place(edge):
    out = substring_dedup.repeated_words(edge, chunk_bytes=3000, replace=True)
    assert out.schema == edge.schema
    want = Counter()
    for (i, t), (_, w, g) in zip(edge_texts(), removed(edge_texts(), 50, lambda t: (t or "").encode().split())):
        want[i, b" ".join(x for x, y in zip(w, g) if not y).decode() if any(g) else t] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert {r.key for r in rows} == {r.key for r in edge.collect()}


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 3000])
def test_repeated_bytes(edge, chunk_bytes):
    rows = suffix_dedup.repeated_bytes(edge, chunk_bytes=chunk_bytes, shards=3).collect()
    want = plain_bytes(edge_texts(), 50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == want


def test_difference_cover():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(None, size=20)


def test_dedup_of_hot_passages(spark):
    """A passage that most documents share, over many chunks."""
    passage = words(9, 60)
    texts = [(i, f"{words(100 + i, 20)} {passage} {words(500 + i, 5)}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(
        docs, chunk_bytes=1500).collect()) == plain_words(texts, 50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_bytes(
        docs, chunk_bytes=1500).collect()) == plain_bytes(texts, 50)


def test_dedup_queries(spark, empty):
    texts = docs_of(spark)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op9_substring_dedup(spark, SF_SMALL).collect()) \
        == Counter({(i, n, g, hashlib.sha256(k.encode()).hexdigest()): c
                    for (i, n, g, k), c in plain_words(texts, 50).items()})
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, SF_SMALL).collect()) \
        == Counter({(i, n, g, s, hashlib.sha256(k).hexdigest()): c
                    for (i, n, g, s, k), c in plain_bytes(texts, 50).items()})
    assert substring_dedup.repeated_words(empty).count() == 0
    assert substring_dedup.repeated_words(empty, replace=True).count() == 0
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(texts, max_bits=4):
    marks = {i: plain_fingerprint(t) for i, t in texts}
    ids = [i for i in marks if i is not None]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (marks[a] ^ marks[b]).bit_count() <= max_bits]
    return marks, components(ids, links)


def test_simhash(spark, edge, empty):
    texts = edge_texts()
    marks, groups = plain_groups([t for t in texts if t[0] is not None])
    rows = simhash.group(edge).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in rows) == Counter(
        (i, plain_fingerprint(t), groups.get(i)) for i, t in texts)
    kept = simhash.keep_first(edge)
    assert kept.schema == edge.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in texts if i is None or groups[i] == i)
    assert simhash.group(empty).count() == simhash.keep_first(empty).count() == 0
    texts = docs_of(spark)
    marks, groups = plain_groups(texts)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op5_simhash(spark, SF_SMALL).collect()} == {
        (i, f"{marks[i]:016x}", groups[i]) for i, _ in texts}


@pytest.mark.parametrize("n_classes", [100, 10**8, 10**11])
def test_simhash_links_in_split_buckets(spark, n_classes):
    """Chains of close fingerprints, all in the same buckets, whatever the number of blocks."""
    r = np.random.default_rng(4)
    marks = {0}
    for _ in range(300):
        marks.add(int(list(marks)[r.integers(len(marks))]) ^ int(np.bitwise_xor.reduce(1 << r.integers(0, 64, 4).astype(object))))
    marks = sorted(marks)
    rows = spark.createDataFrame([(m - 2**64 if m >> 63 else m, k) for k, m in enumerate(marks)], "fingerprint long, node long")
    found = [(x.a, x.b) for x in simhash.links(rows, n_classes, 4, block_rows=16).collect()]
    assert all((marks[a] ^ marks[b]).bit_count() <= 64 for a, b in found)
    every = [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 4]
    assert components(range(len(marks)), found) == components(range(len(marks)), every)


def plain_links(rows, threshold=0.93):
    usable = [(k, i, np.array(v, dtype=float), g) for k, (i, v, g) in enumerate(rows) if i is not None and g is not None
              and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    n, links = Counter(), []
    for x, (k, i, v, g) in enumerate(usable):
        for m, j, w, h in usable[:x]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[k] += 1
                n[m] += 1
                links.append((i, j))
    groups = components({i for i, _, _ in rows if i is not None}, links)
    return Counter((i, n[k], groups.get(i)) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_embeddings(spark, block_rows):
    r = np.random.default_rng(1)
    rows = []
    for c in range(6):
        centre = r.normal(size=16)
        rows += [(len(rows) + k, (centre + r.normal(size=16) * 0.28).astype(np.float32).tolist(), c % 2) for k in range(15)]
    rows += [(200 + k, rows[0][1], 0) for k in range(20)]  # equal vectors
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0),
             (304, rows[0][1], None), (None, rows[0][1], 0), (305, rows[0][1][:8], 0), (306, [], 0), (200, rows[0][1], 0),
             (307, [x * 1e30 for x in rows[0][1]], 0), (308, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame([(*x, "extra", 7) for x in rows],
                                  "vec_id long, embedding array<float>, label int, node string, n int").repartition(3)
    got = embedding_dedup.link(frame, block_rows=block_rows).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == plain_links(rows)
    assert embedding_dedup.link(frame.limit(0)).count() == 0


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(SF_SMALL + "/embeddings.parquet").collect()]
    got = op2_embedding_dedup(spark, SF_SMALL).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == plain_links(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_quantisation_bound_never_drops_a_link():
    """Thresholds equal to cosines that occur."""
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 8))
    x[20:] = x[:20] + r.normal(size=(20, 8)) * 0.3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    for threshold in (0.5, 0.8, 0.93):
        codes, one = embedding_dedup._codes(embedding_dedup._units(x)), np.ones(40, dtype=int)
        sure, open_ = embedding_dedup._coded_tile(codes, np.zeros(40), False, one, threshold, rows=7)
        # the open rows meet again in any order
        some = r.permutation(np.flatnonzero(open_))
        rest = embedding_dedup._open_tile(x[some], tuple(c[some] for c in codes), np.zeros(len(some)), False, one[some],
                                          threshold, rows=7, pairs=5)
        linked = sure.linked.copy()
        linked[some] += rest.linked
        assert (linked == (cosine >= threshold).sum(axis=1) - 1).all()
        assert 0 < sure.linked.sum() and 0 < rest.linked.sum()


def plain_base(texts):
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in texts]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((order(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4))
                  for i, t in tokens)


def test_scores(spark, edge, empty):
    whole = pitman_yor.score(edge).collect()
    small = pitman_yor.score(edge, chunk_bytes=5000).collect()
    for rows in (whole, small):
        assert sorted((order(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                      for r in rows) == plain_base(edge_texts())
        assert all(r.score < 0 for r in rows)
    assert sorted((order(r.doc_id), round(r.score, 6)) for r in whole) == sorted((order(r.doc_id), round(r.score, 6)) for r in small)
    assert pitman_yor.score(empty).count() == 0
    assert pitman_yor.score(edge.where("doc_id = 3"), modulus=1, remainder=0).head().n_known == 0
    rows = op8_pitman_yor(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) \
        == plain_base(docs_of(spark))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    """Over all words that may follow a word: the known ones and one unknown."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    table = pa.table({"doc_id": [*train, held], "text": ["a b a c a b d", "b a b c", "a a a b", "a a b a c a d a unknown a"]})
    k = pitman_yor._Tokens(table, "doc_id", "text", 7, 2)

    def give(keys, columns, base=0):
        return {base + s: pack_parts(*(pack_array(np.asarray(c)[part].astype(np.int64)) for c in columns))
                for s, part in pitman_yor._parts(keys, 2)}
    count = k.counts(k.token, len(k.words))
    got = {"counts": give(k.words, [count]) | give(k.pairs, [k.counts(k.pair, len(k.pairs)), np.ones(len(k.pairs))], 2)}
    totals = {"tokens": int(count.sum()), "words": int((count > 0).sum()), "discount": 0.4}
    seats = pitman_yor._Model(k, got, 2, [], totals).seats(0)
    of_context, of_word = (np.bincount(x, seats, len(k.words)) for x in (k.left, k.right))
    own = np.minimum(of_word, 1)
    got["sweep0"] = give(k.words, [of_context, of_word, own])
    sweeps = [{"customers": of_word.sum(), "tables": own.sum(), "discount": 0.3}]
    p = pitman_yor._Model(k, got, 2, sweeps, totals).probabilities(0)
    a = k.token[0]
    assert len(set(k.right[k.left == a])) == totals["words"] + 1
    assert abs(p[k.left == a].sum() - 1) < 1e-12


def test_seating():
    key = np.random.default_rng(5).integers(0, 2**63, 1000, dtype=np.uint64)  # keys are hashes
    customers = np.full(1000, 500)
    few, many = (pitman_yor.seat(key, customers, np.full(1000, w), 0.5, 1) for w in (0.01, 5.0))
    assert (few >= 1).all() and (many <= 500).all() and many.mean() > few.mean()
    assert (pitman_yor.seat(key, np.zeros(1000, dtype=int), np.ones(1000), 0.5, 1) == 0).all()
    assert (pitman_yor.seat(key, np.ones(1000, dtype=int), np.ones(1000), 0.5, 1) == 1).all()
    exact = sum(5.0 / (5.0 + j) for j in range(1, 500))  # expected new tables with no discount
    assert abs(pitman_yor.seat(key, customers, np.full(1000, 5.0), 0.0, 3).mean() - 1 - exact) < 0.5


def test_chunks_are_bounded_in_bytes(spark):
    """Long documents side by side, a third of the rows without an id and many with one id."""
    passage = words(77, 60)
    texts = [(i, words(i, 5)) for i in range(900)] + [(900 + i, words(5000 + i, 400)) for i in range(60)]
    texts += [(None, f"{passage} {words(7000 + i, 10)}") for i in range(300)]
    texts += [(950, f"{words(8000 + i // 2, 60)} {passage}") for i in range(200)] + [(2000 + i, passage) for i in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    chunks = Chunks(docs, "doc_id", "text", 20_000)
    assert max(r.n for r in chunks.frame.groupBy("chunk").agg(F.sum("n_bytes").alias("n")).collect()) <= 40_000
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(
        docs, chunk_bytes=20_000).collect()) == plain_words(texts, 50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_bytes(
        docs, chunk_bytes=20_000).collect()) == plain_bytes(texts, 50)
    whole, parts = (Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in pitman_yor.score(
        docs, chunk_bytes=n).collect()) for n in (4 << 20, 20_000))
    assert whole == parts


def balanced(n, flip=False):
    """A word of ``n`` letters, the parities of the bits of 0 .. n - 1: sums modulo 2**64 can't tell it from its complement."""
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 512, 1024, 4096])
def test_long_balanced_words_differ(spark, n):
    same = words(9, 49)
    texts = [(1, f"{same} {balanced(n)}"), (2, f"{same} {balanced(n, True)}"), (3, f"{same} {balanced(n)}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    for size in (4 << 20, 64):
        got = {r.doc_id: r.n_removed for r in substring_dedup.repeated_words(docs, chunk_bytes=size).collect()}
        assert got == {1: 0, 2: 0, 3: 50}


def test_vectors_that_share_an_id(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (8, [1.0, 0.01], 0), (9, [0.01, 1.0], 0), (3, [0.011, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.link(frame).collect())
    assert got == [(3, 2, 3), (7, 1, 7), (7, 2, 3), (8, 1, 7), (9, 2, 3)]


def test_texts_that_share_an_id_are_one_document(spark):
    a, b, c = words(21, 60), words(22, 60), words(23, 60)
    rows = [(3, a), (5, b), (5, a), (9, b), (11, c), (None, b), (12, None), (12, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.group(docs).collect())
    assert [(i, g) for _, i, g in got] == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (12, 11), (12, 11), (None, None)]
    assert sorted(r.doc_id for r in simhash.keep_first(docs).where("doc_id is not null").collect()) == [3, 11]
