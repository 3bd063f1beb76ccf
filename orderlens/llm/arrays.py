"""Arrow text columns as numpy arrays: words, spans and their hashes.

A batch of texts is one byte buffer plus offsets, so splitting into words,
hashing words and hashing windows are array operations over the whole batch;
nothing here loops over documents or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# fixed values: the word separators of the operators' contracts (ASCII blanks)
BLANKS = b" \t\n\v\f\r"
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[list(BLANKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U64 = np.uint64
LONG_WORD = 64  # bytes beyond which a polynomial modulo 2**64 is no safe hash
# two odd multipliers and byte tables: independent 64-bit hashes 0 and 1
_BASE = (_U64(0x9E3779B97F4A7C17), _U64(0xC2B2AE3D27D4EB4B))
_TABLE = tuple(np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
               for s in (11, 23))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Texts:
    """``n`` texts as one UTF-8 buffer; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column) -> Texts:
        """From an Arrow string or binary array (chunked or not)."""
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                                  else b"").cast(pa.large_binary())
        n = len(column)
        _, off, data = column.buffers()
        if n == 0:
            return cls(np.empty(0, np.uint8), np.zeros(1, np.int64))
        off = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
        data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
        return cls(data, off - off[0])

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of about ``limit`` bytes of text each,
    so that working arrays stay small; a longer text has a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = Texts.of(batch.column(batch.schema.get_field_index(text))).offsets[1:]
        lo, base = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            base, lo = int(ends[hi - 1]), hi


class Words:
    """Maximal runs of bytes outside ``separators``; words never cross texts."""

    def __init__(self, texts: Texts, separators: np.ndarray = IS_BLANK):
        data, off = texts.data, texts.offsets
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads, tails = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
        first[heads] |= inside[heads]
        last[tails] |= inside[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, off)  # of each text's words
        self.counts = np.diff(self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @classmethod
    def spans(cls, starts: np.ndarray, ends: np.ndarray) -> Words:
        """Given spans, in order, as words (without their texts)."""
        out = cls.__new__(cls)
        out.starts, out.ends = starts, ends
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (xor-shift-multiply finaliser)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(int(_BASE[which]), -1, 2**64)
        out = []
        for b in (_BASE[which], _U64(inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = tuple(out)
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, by prefix sums of a
    polynomial modulo 2**64; equal contents give equal hashes anywhere."""
    pos, neg = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * pos[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * neg[starts])


def word_hash(texts: Texts, words: Words, which: int = 0, lower: bool = False, slice_bytes: int = 1 << 18) -> np.ndarray:
    """64-bit hash of every word's bytes (A-Z as a-z if ``lower``): a polynomial
    for the usual ones, XXH64 for those of more than LONG_WORD bytes."""
    table = _TABLE[which][LOWER] if lower else _TABLE[which]
    out = np.empty(len(words), dtype=np.uint64)
    lo = 0
    while lo < len(words):
        base = int(words.starts[lo])
        hi = max(lo + 1, int(np.searchsorted(words.ends, base + slice_bytes, "right")))
        s, e = words.starts[lo:hi] - base, words.ends[lo:hi] - base
        h = span_hash(table[texts.data[base:base + int(e[-1])]], s, e, which)
        out[lo:hi] = mix(h + (e - s).astype(np.uint64))
        lo = hi
    for i in np.flatnonzero(words.ends - words.starts > LONG_WORD).tolist():
        word = texts.data[words.starts[i]:words.ends[i]]
        out[i] = xxhash.xxh64_intdigest((LOWER[word] if lower else word).tobytes(), seed=which)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct integers in order (a sort; ``np.unique`` hashes 64-bit integers and takes far longer)."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def windows(words: Words, size: int) -> np.ndarray:
    """Index of the first word of every run of ``size`` words of one text."""
    n = np.maximum(words.counts - size + 1, 0)
    return ranges(words.offsets[:-1], n)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for every start, concatenated."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    some = counts > 0
    starts, counts = starts[some], counts[some]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    step[at] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` items lie in some run [start, start + size)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def hash_at(data: np.ndarray, at: np.ndarray, size: int, which: int = 0, slice_bytes: int = 1 << 18) -> np.ndarray:
    """64-bit hash of ``data[i:i + size]`` for every ``i`` of sorted ``at``."""
    out = np.empty(len(at), dtype=np.uint64)
    lo = 0
    while lo < len(at):
        base = int(at[lo])
        hi = int(np.searchsorted(at, base + slice_bytes))
        s = at[lo:hi] - base
        out[lo:hi] = span_hash(_TABLE[which][data[base:base + int(s[-1]) + size]], s, s + size, which)
        lo = hi
    return out
