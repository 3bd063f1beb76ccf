"""BPE, packing and quality against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from orderlens.llm import bpe, packing, quality
from orderlens.llm.queries import op1_bpe, op10_packing, op4_quality, tokenizer
from tests.conftest import SF_SMALL
from tests.llm.conftest import edge_texts

BYTES, WORDS, PIECES = (tokenizer(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n=1500):
    r = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x130, 0x3A3, 0xFB01,
                             *(r.randrange(0x250, 0xD800) for _ in range(200))]]
    usual = [" ", "  ", "\n", "'s", "'ll", "a", "aaa", "the", "12", "!!", "<|endoftext|>", "<|startoftext|>", "é", "\0"]
    return ["".join(r.choice(pool if r.random() < 0.3 else usual) for _ in range(r.randrange(25))) for _ in range(n)]


def test_encoding_equals_the_library():
    ours, theirs = bpe.vocabulary(BYTES), library(BYTES)
    for text in [*odd_texts(), "a" * 5000, "ab" * 1000 + "é" * 500, *(t for _, t in edge_texts()[:9] if t)]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        packed = ours.encode(text)
        assert packed == np.array(ids, dtype="<u4").tobytes(), ascii(text)
        assert ours.decode(np.frombuffer(packed, "<u4")) == theirs.decode(ids, skip_special_tokens=False)


def test_decoding_of_any_ids_replaces_broken_bytes():
    ours, theirs = bpe.vocabulary(BYTES), library(BYTES)
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        assert ours.decode(np.array(ids, dtype="<u4"), block=1 << 18) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark, edge, empty):
    texts = Counter((i, t or "") for i, t in edge_texts())
    out = bpe.decode(bpe.encode(edge, BYTES), BYTES).collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == texts
    assert bpe.encode(empty, BYTES, decoded=True).count() == 0
    theirs = library(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()}
    rows = op1_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_word_ids_equal_the_library():
    ours, theirs = packing._Encoder(WORDS, cache_words=300), library(WORDS)
    texts = [*odd_texts(), "IT'S. The: end|", "İstanbul!! ΣΑΣ.", *(t for _, t in edge_texts()[:9] if t)]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at:at + 50], ours.encode(texts[at:at + 50])):
            assert ids == np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_added_tokens_keep_their_case():
    ours, theirs = packing._Encoder(WORDS), library(WORDS)
    for text in ("The <|ENDOFTEXT|> end", "a<|EndOfText|>B", "An <|endoftext|> End <|STARTOFTEXT|>.", "x <| Y |> z"):
        ids, = ours.encode([text])
        assert ids == np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_all_lengths(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 64): r.randint(1, 1000) for _ in range(r.randint(1, 40))}
    found = Counter()
    for count, pattern in packing.patterns(histogram, 64):
        assert sum(size * times for size, times in pattern) <= 64
        for size, times in pattern:
            found[size] += count * times
    assert found == histogram
    assert packing.patterns({}, 64) == []
    assert packing.patterns({10: 13}, 64) == [(2, [(10, 6)]), (1, [(10, 1)])]


def check_packing(rows, texts, length):
    theirs = library(WORDS)
    want = Counter()
    for i, t in texts:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for at in range(0, len(ids), length):
            want[i, at, len(ids[at:at + length]), zlib.crc32(ids[at:at + length].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= length
    return sum(n for p in by.values() for _, n in p) / (length * max(1, len(by)))


def test_packing(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 4)  # several slices for a length
    check_packing(packing.pack_documents(edge, WORDS, length=256).collect(), edge_texts(), 256)
    assert packing.pack_documents(empty, WORDS).count() == 0
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()]
    assert check_packing(op10_packing(spark, SF_SMALL).collect(), texts, 4096) > 0.97
    hot = spark.createDataFrame([(i, "same words") for i in range(60)], "doc_id long, text string")
    check_packing(packing.pack_documents(hot, WORDS, length=16).collect(), [(i, "same words") for i in range(60)], 16)


def plain_counts(text):
    w = text.encode().split()
    at = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if at[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_counts_and_bands(spark, edge, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for rows, texts in ((quality.judge(quality.measures(edge, PIECES)).collect(), edge_texts()),
                        (op4_quality(spark, SF_SMALL).collect(),
                         [(r.doc_id, r.text) for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()])):
        assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == Counter(
            (i, *plain_counts(t or "")) for i, t in texts)
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality.judge(quality.measures(empty, PIECES)).count() == 0


def test_quality_rejects_what_doesnt_fit_its_language(spark):
    good = [(i, " ".join(random.Random(i).choices("the of a house river stone and was green walking there small".split(), k=80)), "en")
            for i in range(60)]
    bad = [(100, " ".join("".join(random.Random(k).choices("ሀሐᎠⰀ", k=6)) for k in range(80)), "en")]
    rows = quality.judge(quality.measures(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), PIECES)).collect()
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == {100}
    assert next(r.byte_share for r in rows if r.doc_id == 100) > 0.5


def test_quality_measures_decide(spark):
    """Little entropy for its length, few characters a token and byte tokens each reject a text of any length."""
    vocabulary = [w for k in range(40) for w in random.Random(k).sample(
        "the of a house river stone and was green walking there small garden evening water people story".split(), 9)]

    few = "the of river stone walking garden".split()  # as long as the others

    def text(seed, n, of):
        return " ".join(random.Random(seed).choices(of, k=n))
    rows = [(i, text(i, 60 + 13 * (i % 90), vocabulary), "en") for i in range(900)]
    rows += [(1000 + i, text(i, 60 + 13 * (i % 90), few), "en") for i in range(0, 90, 6)]
    rows += [(2000, " ".join(random.Random(k).choice("qzxjkvwy") * 2 + random.Random(-k).choice("qzxjkvwy") for k in range(200)), "en"),
             (3000, text(1, 200, vocabulary) + " ሀሐᎠⰀ" * 3, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judge(quality.measures(docs, PIECES), max_repeat_percent=100).collect()
    lost = {r.doc_id for r in out if not r.kept}
    assert lost >= {1000 + i for i in range(0, 90, 6)} | {2000, 3000}
    assert len([i for i in lost if i < 1000]) < 20
