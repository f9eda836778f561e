"""Vectorised byte and word kernels shared by the text operators.

Everything works on Arrow string buffers directly (UTF-8 bytes plus offsets),
so a batch of documents is hashed, split into words or windowed without a
Python object per word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
MULT = U64(0x9E3779B97F4A7C15)
PAIR = U64(0xD6E8FEB86659FD93)
#: Text bytes worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Values worked on at once by long kernels: what fits the inner caches.
BLOCK = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64 bits over 64 bits, one to one."""
    if x.ndim == 1 and len(x) > 2 * BLOCK:
        out = np.empty(len(x), U64)
        for i in range(0, len(x), BLOCK):
            out[i : i + BLOCK] = mix(x[i : i + BLOCK])
        return out
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair of two names."""
    if a.ndim == 1 and len(a) > 2 * BLOCK and b.ndim == 1 and len(b) == len(a):
        out = np.empty(len(a), U64)
        for i in range(0, len(a), BLOCK):
            out[i : i + BLOCK] = mix(a[i : i + BLOCK] * PAIR + b[i : i + BLOCK])
        return out
    return mix(a * PAIR + b)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 byte offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_null(column.type) else pa.array([None] * len(column), pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each, in order."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the documents.

    A word is a run of bytes that are none of space, tab, LF, VT, FF and CR; it never crosses documents.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edges - 1] |= word[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for the bytes of each span."""
    lens = ends - starts
    out = mix(lens.astype(U64) + MULT)
    order = np.argsort(lens, kind="stable")[::-1]
    by_len, at = lens[order], starts[order]
    acc = out[order]
    limit = int(by_len[0]) if len(by_len) else 0
    live = len(by_len)
    for j in range(min(limit, 64)):
        live = int(np.searchsorted(-by_len, -j, "left"))
        acc[:live] = acc[:live] * MULT + BYTE_CODE[data[at[:live] + j]]
    if limit > 64:
        import hashlib

        for i in range(int(np.searchsorted(-by_len, -64, "left"))):
            acc[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + by_len[i]].tobytes(), digest_size=8).digest(), "little")
    out[order] = acc
    return mix(out)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, and the word offsets of the documents."""
    if lower:
        data = LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(data, starts, ends), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for every start, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = counts > 0
    s, c = starts[full], counts[full]
    at = np.concatenate([[0], np.cumsum(c)[:-1]])
    out[at] = s
    out[at[1:]] -= s[:-1] + c[:-1] - 1
    return np.cumsum(out)


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of ``size`` words and their offsets by document.

    A document of 1 to size - 1 words has one shingle, of all its words.
    """
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = ranges(at[:-1], counts)
    names = np.full(len(first), MULT, U64)
    doc_end = np.repeat(at[1:], counts)
    for j in range(size):
        inside = first + j < doc_end
        nxt = words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else np.zeros(0, U64)
        names = np.where(inside, names * PAIR + nxt, names)
    return mix(names), np.concatenate([[0], np.cumsum(counts)])


#: Multiplier of Checks and its inverse modulo 2**64.
_STEP = 0x9FB21C651E98DF25
_BACK = pow(_STEP, -1, 1 << 64)
_CODE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _powers(base: int, x: np.ndarray) -> np.ndarray:
    """base ** x modulo 2**64, from two small tables."""
    top = int(x.max()) if len(x) else 0
    low, high = np.full(4096, base, U64), np.full((top >> 12) + 1, pow(base, 4096, 1 << 64), U64)
    low[0] = high[0] = 1
    return np.cumprod(low)[x & 4095] * np.cumprod(high)[x >> 12]


@lru_cache(maxsize=1)
def _run_of_powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, U64)
    out[:1] = 1
    return np.cumprod(out)


class Checks:
    """Second names of spans, from a polynomial over their symbols: any span in constant time, independent of the first names."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray | None, place: np.ndarray | None):
        """codes: a symbol's code times its power.  Span i to j is from symbol starts[i] and place[i] up to those of j (None: i itself)."""
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(codes)])
        self.sums, self.place = sums if starts is None else sums[starts], place

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Checks:
        """Spans are ranges of bytes."""
        powers = _run_of_powers(2 * CHUNK_BYTES) if len(data) <= 2 * CHUNK_BYTES else _powers(_STEP, np.arange(len(data)))
        return cls(_CODE[data] * powers[: len(data)], None, None)

    @classmethod
    def of_words(cls, data: np.ndarray, starts: np.ndarray) -> Checks:
        """Spans are ranges of words; the white space between them does not count."""
        word = ~IS_SPACE[data]
        begins = np.zeros(len(data), np.int64)
        begins[starts] = 1
        symbol = np.concatenate([[0], np.cumsum(word)])
        edge = np.append(starts, len(data))
        at = np.flatnonzero(word)
        # a word's bytes follow a free place, so places tell where words begin
        places = np.arange(len(at)) + np.cumsum(begins)[at]
        powers = _run_of_powers(4 * CHUNK_BYTES)[places] if len(data) <= 2 * CHUNK_BYTES else _powers(_STEP, places)
        return cls(_CODE[data[at]] * powers, symbol[edge], symbol[edge] + np.arange(len(edge)))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = (a, b) if self.place is None else (self.place[a], self.place[b])
        return mix((self.sums[b] - self.sums[a]) * _powers(_BACK, p) + (q - p).astype(U64) * MULT)
