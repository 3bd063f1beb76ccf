"""Licence scan, hard negatives and centroid clustering against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from orderlens.llm import centroids, hard_negatives, license_scan, vectors

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_labels(text, templates=license_scan.TEMPLATES, threshold=0.9, run=3):
    """Every block against every template."""
    words = WORD.findall(low(text))
    found = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    lines, added, most = low(text).split("\n"), set(), 0.0
    for i in range(len(lines)):
        block = set(WORD.findall("\n".join(lines[i:i + run])))
        for label, sentence in templates:
            t = set(sentence.split())
            if len(t & block) >= math.ceil(round(threshold * len(t), 9)):
                added.add(label)
                most = max(most, len(t & block) / len(t))
    base = {label for _, label in found}
    return (len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
            sorted(base), sorted(base | added), 1.0 if found else most)


def licence_texts():
    r = random.Random(3)
    sentences = [s for _, s in license_scan.TEMPLATES]
    out = ["cc by cc by", "CC-BY\nAll rights Reserved. all RIGHTS reserved", "ccby", "cc", "K cc BYé", "ÀCC BY",
           "Released under\nthe MIT\nLicense!", "Released\nunder\nthe MIT\nLicense!", "general  public\tlicense\r\ncc\x00by",
           "the " * 3000 + "released under the mit license"]
    for s in sentences:
        for drop in range(4):
            words = s.split()
            for _ in range(drop):
                words.pop(r.randrange(len(words)))
            r.shuffle(words)
            out.append(" ".join(w + r.choice([" ", "\n", ", ", " lorem "]) for w in words))
    return out


def test_licences_equal_every_pair(spark, edge):
    rows = [(i, t, None, "x") for i, t in enumerate(licence_texts())] + [(0, "cc by", None, "x"), (0, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, labels string").repartition(4)
    for frame in (docs, edge):
        got = sorted(map(tuple, license_scan.label(frame).collect()), key=repr)
        want = sorted(((r["doc_id"], *plain_labels(r["text"])) for r in frame.collect()), key=repr)
        assert [(*g[:5], list(g[5]), list(g[6]), g[7]) for g in got] == want


@pytest.mark.parametrize("threshold, run", [(0.5, 1), (0.75, 2), (1.0, 5)])
def test_licence_filters_lose_no_pair(spark, threshold, run):
    r = random.Random(run)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"t{i}", " ".join(r.sample(vocabulary, r.randint(1, 6)))) for i in range(15)]
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.randint(0, 4))) for _ in range(r.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.label(docs, templates=templates, threshold=threshold, run=run).collect()
    for row in found:
        want = plain_labels(texts[row["doc_id"]], templates, threshold, run)
        assert (row["labels"], row["score"]) == (want[5], want[6])


def test_licences_of_an_empty_table(empty):
    assert license_scan.label(empty).collect() == []


SCHEMA = "vec_id long, embedding array<float>, label int, row string, block long, part string"


def rows_of(seed, n, dims, labels=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((labels, dims))
    out = []
    for i in range(n):
        x = (r.standard_normal(dims) + centres[i % labels] * 0.5).astype(np.float32) / 4
        out.append((i, x.tolist(), int(i % labels), "x", None, "y"))
    return out


def odd_rows(dims):
    """Repeated ids and vectors, nulls, non-finite components, other lengths, huge and empty vectors."""
    v = [0.25] * dims
    return [(3, v, 1, None, 1, None), (3, v, 1, None, 1, None), (100, v, 1, None, 1, None), (100, v, 2, None, 1, None),
            (None, v, 1, None, 1, None), (300, v, None, None, 1, None), (400, None, 1, None, 1, None),
            (500, [None, *v[1:]], 1, None, 1, None), (600, [float("nan"), *v[1:]], 1, None, 1, None),
            (700, [float("inf"), *v[1:]], 1, None, 1, None), (800, v[1:], 1, None, 1, None), (801, v[1:], 2, None, 1, None),
            (900, [], 1, None, 1, None), (901, [], 2, None, 1, None), (902, [], 1, None, 1, None), (1000, [1e30] * dims, 1, None, 1, None),
            (1100, [0.0] * dims, 1, None, 1, None)]


def usable(x, scale, dims=None):
    if x is None or (dims is not None and len(x) != dims) or any(c is None or not math.isfinite(c) for c in x):
        return None
    whole = [math.floor(scale * float(c)) for c in x]
    return None if any(abs(c) >= min((2 ** 61 / len(x)) ** 0.5, 2 ** 31) for c in whole) else whole


def plain_negatives(rows, every, top, best, least, most):
    kept = [(i, label, usable(x, 256)) for i, x, label, *_ in rows if i is not None and label is not None]
    kept = [k for k in kept if k[2] is not None]
    out = []
    for a, (anchor, label, x) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other, k) for k, (i, other, y) in enumerate(kept)
                        if k != a and len(y) == len(x))
        for minus, positive, *_ in [s for s in scored if s[2] == label][:top]:
            negatives = [s for s in scored if s[2] != label and -least * minus <= -100 * s[0] <= -most * minus][:best]
            out += [(anchor, positive, n + 1, i, -minus, -score) for n, (score, i, *_) in enumerate(negatives)]
    return sorted(out)


@pytest.mark.parametrize("dims, block_rows, per_block, group", [(64, 4096, 4096, 8), (5, 16, 2, 1), (70, 32, 3, 2), (1, 8, 100, 3)])
def test_hard_negatives_equal_every_pair(spark, dims, block_rows, per_block, group):
    rows = rows_of(dims, 150, dims) + odd_rows(dims) + rows_of(dims, 20, dims)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.mine(frame, every=20, positives=4, negatives=6, block_rows=block_rows, per_block=per_block, group=group)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 20, 4, 6, 30, 90)


def test_hard_negatives_of_empty_tables_and_without_anchors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame(rows_of(1, 9, 4)[1:], SCHEMA)
    assert hard_negatives.mine(frame, every=100).collect() == []


@pytest.mark.parametrize("dims, scale", [(64, 1.0), (7, 1000.0), (200, 1e-3), (1, 3.0)])
def test_intervals_hold_every_product(dims, scale):
    r = np.random.default_rng(dims)
    x = np.floor(r.standard_normal((300, dims)) * 256 * scale).astype(np.int32)
    x[:5] = 0
    widths = []
    for levels in (1, 3, 6):
        codes, align, left = hard_negatives.encode(x, levels)
        q = hard_negatives.Query(x[:40], levels, 6)
        low_, high = q.interval(slice(0, 40), codes, align, left, np.linalg.norm(x.astype(float), axis=1))
        exact = x[:40].astype(np.int64) @ x.T.astype(np.int64)
        assert (low_ <= exact).all() and (exact <= high).all()
        widths.append((high - low_).mean())
    if dims >= 64 and scale >= 1:
        assert widths[2] < widths[1] / 2 < widths[0] / 4  # each code leaves less


def plain_clusters(rows, k, dims, scale, rounds, seed):
    kept = [(i, usable(x, scale, dims)) for i, x, *_ in rows]
    kept = [v for v in kept if v[1] is not None]
    order = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"{seed}:{v[0]}".encode()).hexdigest(), v[1]))
    centres = [x for _, x in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres)) for _, x in kept]
    for _ in range(rounds):
        of = nearest()
        for n in range(len(centres)):
            own = [x for (_, x), (_, m) in zip(kept, of) if m == n]
            if own:
                centres[n] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, nearest())), key=repr), centres


@pytest.mark.parametrize("dims, shards, block_rows", [(6, 4, 16), (6, 1, 1000), (64, 4, 32), (3, 8, 7)])
def test_clusters_equal_plain_rounds(spark, dims, shards, block_rows):
    rows = rows_of(dims, 120, dims) + odd_rows(dims)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, centres = centroids.cluster(frame, k=5, dims=dims, rounds=6, shards=shards, block_rows=block_rows)
    want, plain = plain_clusters(rows, 5, dims, 1024, 6, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert centres.tolist() == plain
    total = centroids.with_inertia(found).select("cluster", "cluster_inertia", "inertia").distinct().collect()
    for cluster, inertia, whole in total:
        assert inertia == sum(d for _, c, d in want if c == cluster)
        assert whole == sum(d for *_, d in want)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(7, [1.0, 2.0], 0, None, None, None), (8, [1.0, 2.0], 0, None, None, None)], SCHEMA)
    found, centres = centroids.cluster(frame, k=8, dims=2)
    assert sorted(map(tuple, found.collect())) == [(7, 0, 0), (8, 0, 0)] and centres.tolist() == [[1024, 2048]] * 2
    for rows in ([], [(1, [1.0], 0, None, None, None)]):
        found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA), dims=2)
        assert centroids.with_inertia(found).collect() == [] and len(centres) == 0


def test_components_are_whole_and_bounded():
    import pyarrow as pa
    column = pa.array([[0.5, -0.001], None, [None, 1.0], [float("nan"), 1.0], [1e300, 0.0], []], pa.list_(pa.float64()))
    good, size, x = vectors.components(column, 1024)
    assert good.tolist() == [True, False, False, False, False, True] and size.tolist() == [2, 0, 2, 2, 2, 0]
    assert x[:2].tolist() == [512, -2]


def test_blocks_keep_every_row():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"vec_id": list(range(a, a + 7)), "embedding": [[float(i)] * (1 + i % 2) for i in range(a, a + 7)]})
               for a in (0, 7, 14)]
    for rows in (1, 2, 3, 100):
        found = list(itertools.chain.from_iterable(
            zip(t.column("vec_id").to_pylist(), m.tolist()) for t, m in vectors.matrices(iter(batches), "embedding", 1, rows)))
        assert sorted(found) == [(i, [i] * (1 + i % 2)) for i in range(21)]
        assert all(len(m) <= rows for _, m in vectors.matrices(iter(batches), "embedding", 1, rows))
