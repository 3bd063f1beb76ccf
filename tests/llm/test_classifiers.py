"""Toxicity, secret scans and the pipeline."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from orderlens.llm import secret_scan, toxicity
from orderlens.llm.arrays import Texts, text_slices
from orderlens.llm.queries import op3_secret_scan, op6_toxicity, tokenizer
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import edge_texts, words

def usable():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def test_toxicity_learns_planted_words(spark):
    r = random.Random(1)
    rows = [(i, words(i, 40) + (" you utter nincompoop " if i % 5 == 0 else " ") + words(1000 + i, 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if r.random() < 0.9] + [(5000, 1), (None, 1), (3, None)],
                                   "doc_id long, toxic int")
    weights = toxicity.train(docs, labels, usable(), l1=1.0)
    assert 0 < len(weights.features) < 20_000
    scored = {x.doc_id: x.score for x in toxicity.score(docs, weights).collect()}
    caught = [scored[i] >= 0.3 for i, _ in rows if i % 5 == 0]
    assert np.mean(caught) > 0.95 and np.mean([scored[i] >= 0.3 for i, _ in rows if i % 5]) < 0.05


def test_toxicity_sends_the_driver_only_weights(spark, monkeypatch):
    """Rows in any order and partitions; the state of the fit, two numbers for each of 2**bits coordinates, stays in its task."""
    r, bits, sent = np.random.default_rng(3), 18, []
    rows = [(i, i % 2, np.unique(np.append(r.integers(0, 1 << bits, 40), i % 2)).astype(np.uint32)) for i in range(300)]
    sample = spark.createDataFrame([(i, y, bytearray(at.tobytes())) for i, y, at in rows[::-1]],
                                   "_order long, label int, grams binary").repartition(5)
    collect = type(sample).collect
    monkeypatch.setattr(type(sample), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    got = toxicity.fit(sample, bits)
    assert sent and sum(len(value) for rows_ in sent for row in rows_ for value in row) < 1 << bits
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _, y, grams in rows * 3:
        at = np.append(grams.astype(np.int64), 1 << bits)
        w = toxicity._weights(z, n, at, 0.5, 1.0, 4.0, 1.0)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        root = np.sqrt(n[at])
        n[at] += g * g
        z[at] += g - (np.sqrt(n[at]) - root) / 0.5 * w
    used = np.flatnonzero(n)
    w = toxicity._weights(z, n, used, 0.5, 1.0, 4.0, 1.0)
    assert 0 < len(got.features) and got.features.tolist() == used[w != 0][:-1].tolist()
    assert got.values.tolist() == w[w != 0][:-1].tolist() and got.intercept == w[-1] != 0
    assert got.features.dtype == np.int64


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")
    weights = toxicity.train(edge, labels, usable())
    out = toxicity.score(edge, weights, into="toxicity")
    assert out.columns == [*edge.columns, "toxicity"]
    rows = out.collect()
    assert Counter((x.doc_id, x.text) for x in rows) == Counter(edge_texts())
    assert all(0 <= x.toxicity <= 1 for x in rows)
    assert len({x.toxicity for x in rows if not (x.text or "").strip()}) == 1
    nothing = toxicity.train(empty, labels.limit(0), usable())
    assert len(nothing.features) == 0
    assert {x.toxicity for x in toxicity.score(edge, nothing, into="toxicity").collect()} == {0.5}
    assert toxicity.score(empty, nothing, into="toxicity").count() == 0


def test_toxicity_query(spark):
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(SF_MID + "/labels.parquet").collect()}
    rows = op6_toxicity(spark, SF_MID).collect()
    assert len(rows) == spark.read.parquet(SF_MID + "/documents.parquet").count()
    assert all(x.predicted == int(x.score >= 0.3) for x in rows)
    held = [(x.score, labels[x.doc_id]) for x in rows if x.held_out and x.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert np.mean(pairs) > 0.75  # area under the curve, few labels


def plain_spans(text):
    """The base rules, character by character as stated."""
    out = []
    for kind, number, pattern, flags in (
            ("assign", 0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0),
            ("access", 1, r"AKIA[A-Z0-9]+", 0), ("hex", 2, r"[0-9a-f]+", 0)):
        if number == 0:  # letters of the names in either case
            for name in ("password", "passwd", "secret", "token", "api_?key"):
                either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
                pattern = pattern.replace(name, either, 1)
        for m in re.finditer(pattern, text):
            if len(m[2] if number == 0 else m[0]) >= (6, 20, 24)[number]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def secret_texts():
    r = random.Random(2)

    def hexes(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{words(i, 20)} token = \"{hexes(40)}\" {words(i + 500, 10)} {r.randrange(10**15, 10**16)} 10.20.30.40" for i in range(120)]
    texts += ["PassWord:'abcdef' apikey==abc API_KEY = x1y2z3w4", "secret:abc token=token=abcdef", "AKIA" + "A1" * 8 + " AKIAAKIA",
              "ſecret = abcdefgh toKen  =  abcdefgh", hexes(23) + "g" + hexes(24), "", None, "é" * 40 + " passwd: " + "a" * 5000,
              "token=abcdef" * 3, "secret = token: abcdefghi", f"bare {hexes(22)} here", "f" * 3000]
    return texts


def test_base_rules():
    for text in secret_texts():
        got = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e, _ in secret_scan.base_spans(text or "")]
        assert got == plain_spans(text or ""), text


def test_inferred_formats(spark, edge, empty):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grammar = secret_scan.learn(docs)
    assert len(grammar.kinds) == 2  # assigned values and hex; two access keys are too few to learn from
    rows = {x.doc_id: x.spans for x in secret_scan.scan(docs, grammar).collect()}
    inferred = {i: [texts[i][s.start:s.end] for s in spans if s.kind == "inferred"] for i, spans in rows.items()}
    assert inferred[len(texts) - 2] == [texts[-2].split()[1]]  # 22 hex digits: no base rule finds them
    assert not any(inferred[i] for i in range(120))  # numbers and addresses aren't secrets
    for i, spans in rows.items():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind != "inferred"] == plain_spans(texts[i] or "")
        assert spans == sorted(spans, key=lambda s: (s.start, secret_scan.KINDS.index(s.kind)))
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs, grammar).collect()}
    for i, text in clean.items():
        assert (text is None) == (texts[i] is None)
        assert not secret_scan.base_spans((text or "").replace("[secret]", " "))
    assert secret_scan.learn(empty).kinds == []
    assert secret_scan.scan(empty, grammar).count() == 0
    out = secret_scan.redact(edge, secret_scan.learn(edge))
    assert out.schema == edge.schema and Counter((x.doc_id, x.text) for x in out.collect()) == Counter(edge_texts())


def test_common_format_without_a_rule(spark):
    """One in ten long tokens is a 22-digit hex key that no base rule finds."""
    r = random.Random(9)

    def hexes(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))
    bare = {i: hexes(22) for i in range(0, 600, 10)}
    other = [f"{r.randrange(10**15, 10**16)}" if i % 2 else "".join(r.choices("aeinorstuhl", k=18)) for i in range(600)]
    rows = [(i, f"{words(i, 15)} {bare.get(i, other[i])} {words(i + 900, 5)}") for i in range(600)]
    rows += [(1000 + i, f'{words(2000 + i, 15)} token = "{hexes(40)}"') for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammar = secret_scan.learn(docs)
    text = dict(rows)
    found = {(x.doc_id, text[x.doc_id][s.start:s.end]) for x in secret_scan.scan(docs, grammar).collect()
             for s in x.spans if s.kind == "inferred"}
    assert found <= set(bare.items()) and len(found) >= 0.95 * len(bare)
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs, grammar).collect()}
    assert all(value not in clean[i] for i, value in found)


def test_secret_query(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()}
    rows = op3_secret_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for x in rows:
        base = plain_spans(docs[x.doc_id])
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_automaton_tells_formats_apart():
    r = random.Random(4)
    a = secret_scan.Automaton(["ab" * r.randint(3, 20) for _ in range(300)])
    assert a.score("a" * 40) > a.score("0" * 40)
    b = secret_scan.Automaton(["".join(r.choice("0123456789") for _ in range(16)) for _ in range(300)])
    assert b.score("0" * 16) > b.score("a" * 16) and len(b.steps) < 40


def test_text_slices():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"t": ["ab", None, "c" * 50, "", "é"]})
    parts = list(text_slices(iter([batch, batch.slice(0, 0)]), "t", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) == 3
    assert [Texts.of(batch.column(0)).bytes(i) for i in range(5)] == [b"ab", b"", b"c" * 50, b"", "é".encode()]


def test_pipeline_stages(spark, tmp_path, empty):
    """Each stage against what it should do to the documents before it."""
    r = random.Random(3)
    passage = words(99_999, 60)
    rows = [(i, words(i, 80), "en", "s", 1) for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s", 1) for i in range(10)]  # copies
    rows += [(300 + i, f"{words(3000 + i, 90)} {passage} {words(4000 + i, 90)}", "en", "s", 1) for i in range(5)]
    rows += [(400 + i, words(5000 + i, 40) + " vile nincompoop " + words(6000 + i, 40), "en", None, 1) for i in range(40)]
    rows += [(500 + i, words(7000 + i, 50) + ' token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', None, "s", 1)
             for i in range(30)]
    rows += [(600, None, "en", "s", 0), (601, "", "en", "s", 0), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(400 <= i < 500)) for i, *_ in rows if i is not None], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.text for x in docs.collect()} if name != "packing" else None
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            seen[name] = (before, {x.doc_id: x.text for x in after.collect()}, after)
        docs = after
    before, after, _ = seen["toxicity"]
    gone = before.keys() - after.keys()
    assert gone <= set(range(400, 440)) and len(gone) > 36
    before, after, _ = seen["simhash"]
    assert {i for i in before.keys() - after.keys()} >= set(range(200, 210)) and None in after
    assert all(after[i] == before[i] for i in after)
    assert set(range(150)) <= after.keys()
    before, after, frame = seen["substring"]
    assert after.keys() == before.keys()
    assert passage in after[300] and not any(passage in after[300 + i] for i in range(1, 5))
    assert all(x.n_chars == len(x.text) for x in frame.collect() if x.text is not None)
    before, after, _ = seen["secrets"]
    assert all("[secret]" in after[500 + i] and "token" not in after[500 + i].split("[secret]")[1] for i in range(30))
    assert all(after[i] == before[i] for i in range(150))
    rows = docs.collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for x in rows:
        ids = [*library.encode(after[x.doc_id] or "", add_special_tokens=False).ids, 2]
        assert len(ids) == x.doc_tokens and list(x.ids) == ids[x.start:x.start + x.length]
    pieces = [(x.doc_id, x.start, x.length) for x in rows]
    assert {p[0] for p in pieces} == after.keys()
    assert sorted(pieces, key=str) == sorted([(x.doc_id, x.start, x.length) for x in corpus_pipeline.run(
        spark, str(tmp_path)).collect()], key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_candidates(text, spans, least, touching):
    """Every run against every span."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_.=-]{%d,}" % least, text):
        hit = [(s, e) for s, _, e, _ in spans if s < m.end() and e > m.start()]
        open_ = [k for k in range(*m.span()) if not any(s <= k < e for s, e in hit)]
        if not hit or (touching and open_):
            out.append(m.span())
    return out


def test_candidates_equal_every_pair():
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice(["token=", "abcdef0123", "AKIA" + "Z9" * 9, " ", "é", "zz", "0123456789abcdef" * 2, "=", "password: "])
                       for _ in range(r.randint(0, 25)))
        spans = secret_scan.base_spans(text)
        for touching in (False, True):
            assert secret_scan.candidates(text, spans, 8, touching) == plain_candidates(text, spans, 8, touching), text


def test_a_key_dump_takes_linear_time():
    text = " ".join(f"token={i:024x} k{i:020d}" for i in range(100_000))
    began = time.process_time()
    spans = secret_scan.base_spans(text)
    assert len(secret_scan.candidates(text, spans, 16, True)) == 100_000
    assert time.process_time() - began < 20


def test_a_key_around_a_base_span_is_masked_whole(spark):
    texts = [t for t in secret_texts() if t] + ["key A" + "b7" * 9 + "0123456789abcdef01234567" + "d9" * 6 + "Z end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grammar = secret_scan.learn(docs)
    grammar.limit = -10.0  # any candidate counts, so that the span itself is seen
    assert grammar.spans(texts[-1], 16)[0][:2] == (4, 3)
    found = {r.doc_id: r.text for r in secret_scan.redact(docs, grammar).collect()}
    assert found[len(texts) - 1] == "key [secret] end"
