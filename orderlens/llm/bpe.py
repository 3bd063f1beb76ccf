"""Byte-pair encoding by backtracking, decoding by an offset table.

Encoding takes the longest vocabulary entry at each position (an Aho-Corasick
automaton finds the entries of a word in one pass) and keeps it if it can
stand after the entry before: a pair is compatible unless some merge of the
vocabulary crosses its border before the two entries are whole. Otherwise the
next shorter entry is tried, and a position from which no entry fits is never
tried again, so the work is linear in the word's length. A sequence of
entries in which all neighbours are compatible is the result of the merges.

Decoding gathers the entries' bytes from one byte string by an offset table.

Defined results: a null or empty text has no ids; rows are independent, so
repeated ids, repeated texts and extra columns don't matter; a very long text
is encoded word by word.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import ranges, text_slices

# fixed value: the pattern by which byte-level vocabularies split text into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_MERGES = -1  # rank of single bytes


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file, with its tables."""

    def __init__(self, path: str, cache_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.parts: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.parts[i] = token
        self.rank = [BYTE_MERGES] * size
        self.split: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[left + right]
            self.pairs[ids[left], ids[right]] = rank
            if self.rank[whole] == BYTE_MERGES:
                self.rank[whole], self.split[whole] = rank, (ids[left], ids[right])
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if len(token) == 1 or self.rank[i] != BYTE_MERGES:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.reach = [len(p) - 1 for p in self.parts]
        self.shorter = [-1] * size  # the longest entry that is a proper prefix
        for token, i in ids.items():
            self.shorter[i] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), -1)
        self.blob = np.frombuffer(b"".join(self.parts), np.uint8)
        for content, i in self.special.items():
            self.parts[i] = content.encode()
        self.blob = np.frombuffer(b"".join(self.parts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in self.parts])))
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)
        self.parts_known: dict[str, bytes] = {"": b""}
        self.cache_words = cache_words
        self.find = regex.compile(PATTERN).findall
        self.runs = regex.compile(r"\s\s").search
        self.borders = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge joins the two entries' edges while they form.

        Takes the last merge apart again and again; between two steps the
        edge entries stood side by side until the merge of rank ``until``.
        Of two equal merges the one further left comes first.
        """
        rank, split, pairs = self.rank, self.split, self.pairs
        until = len(rank) + len(pairs)
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < until:
                return False
            if rank[left] > rank[right]:
                until, left = rank[left], split[left][1]
            elif rank[right] != BYTE_MERGES:
                until, right = rank[right] + 1, split[right][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [-1] * n
        reach = self.reach
        for end, token in self.automaton.iter(word.decode("latin-1")):
            longest[end - reach[token]] = token  # ends come in order, so the longest stays
        shorter, parts, compatible = self.shorter, self.parts, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(parts[token])
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # no entry fits here: give back the entry before
                dead[at] = 1
                token = out.pop()
                at -= len(parts[token])
                token = token if not dead[at + len(parts[token])] else shorter[token]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.borders and any(s in text for s in self.special):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._encode(x)
                            for x in self.borders.split(text))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        """Words never cross from other characters into white space, so a text
        without runs of white space falls into independent parts that begin
        with one blank each; parts are kept, as most come again."""
        if self.runs(text):
            parts = self.find(text)
        else:
            parts = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        known = self.parts_known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            out = []
            for part in parts:
                ids = known.get(part)
                if ids is None:
                    found = []
                    for word in self.find(part):
                        found += self.encode_word(word.encode())
                    ids = array("I", found).tobytes()
                    if len(known) < self.cache_words and len(part) <= 64:
                        known[part] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: np.ndarray, block: int = 1 << 18) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        out = []
        for k in range(0, len(ids), block):
            part = ids[k:k + block].astype(np.int64)
            starts = self.starts[part]
            out.append(self.blob[ranges(starts, self.starts[part + 1] - starts)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]): ids of every text as packed little-endian
    unsigned 32-bit integers; with ``decoded`` also their text again."""
    docs = docs.select(doc_id, text)
    schema = T.StructType([docs.schema[doc_id], T.StructField("ids", T.BinaryType()),
                           *([T.StructField("decoded", T.StringType())] if decoded else [])])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in text_slices(batches, text, 1 << 20):
            ids = [v.encode(t or "") for t in b.column(1).to_pylist()]
            out = [b.column(0), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([v.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema=arrow)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of packed ``ids`` added as column ``into``; null ids give an empty text."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in text_slices(batches, ids):
            packed = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = [v.decode(np.frombuffer(x or b"", "<u4")) for x in packed]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema=arrow)
    return rows.mapInArrow(run, schema)
