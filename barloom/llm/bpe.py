"""Operator 10: byte-level BPE encoding and decoding, by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry as a whole is one token, found by one probe and one comparison
of bytes.  Tier two merges the others: a heap of adjacent pairs by rank over a
doubly linked list of bytes.  Pre-tokens are found for a whole batch at once
from character classes, and each distinct pre-token of a batch is looked up
once, so the work in Python follows the distinct pre-tokens.

Null and empty texts have no tokens.  Texts of any length are encoded whole.
Repeated rows are encoded each, whatever their ids; an empty table gives an empty
result.  Columns of the input that are called as those added, in any case of
letters, are replaced by them; all others pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernels as K
from ._io import unused

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: What a pre-token may be after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The pattern that pretokens() stands for; encode() refuses any other.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct merged pre-tokens, and their bytes, that a worker remembers before it starts afresh.
MEMO, MEMO_BYTES = 100_000, 16 << 20


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, by general category."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, and their offsets by document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    doc_at = np.searchsorted(byte_at, offsets)
    kind = char_classes()[chars]
    n = len(kind)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[doc_at[doc_at < n]] = True
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    last = np.zeros(n + 1, bool)
    last[doc_at] = True
    # White space before a word: all but its last character, then that one; a last plain space joins the word.
    white = kind[runs] == SPACE
    before = white & ~last[ends]
    joins = before & (chars[ends - 1] == 0x20)
    begins[ends[before] - 1] = True
    begins[ends[joins]] = False
    # An apostrophe alone, not after a plain space, takes one of the suffixes that follows it.
    alone = (chars[runs] == 0x27) & (ends - runs == 1) & begins[runs] & ~last[ends]
    at = runs[alone]
    at = at[kind[at + 1] == LETTER]
    if len(at):
        room = np.append(chars, [0, 0, 0])
        word_end = ends[np.searchsorted(runs, at + 1)]
        for suffix in SUFFIXES:
            hit = at + len(suffix) < word_end  # the last of the suffix is still in the letters' run
            for j, c in enumerate(suffix):
                hit &= room[at + 1 + j] == ord(c)
            begins[at[hit] + 1] = False
            after = at[hit] + 1 + len(suffix)
            begins[after[after < n]] = True
            at, word_end = at[~hit], word_end[~hit]
    first = np.flatnonzero(begins)
    return byte_at[first], byte_at[np.append(first[1:], n)], np.searchsorted(first, doc_at)


class PerfectHash:
    """Minimal perfect hash by hash and displace: a bucket holds the seed that sends its keys to free slots.

    A bucket of one key holds its slot itself, as a negative number, so that the last free slots are found at once.
    """

    TRIES = np.arange(64, dtype=np.uint64)

    def __init__(self, names: np.ndarray):
        self.n, self.buckets = len(names), max(1, len(names) // 3)
        bucket = self._bucket(names)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seeds = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        self.slots = np.zeros(self.n, np.int64)
        size = np.diff(start)
        for b in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
            own = order[start[b] : start[b + 1]]
            seed = 0
            while True:
                to = np.sort(self._slot(names[own][None, :], (self.TRIES + K.U64(seed))[:, None]), axis=1)
                good = np.flatnonzero(~taken[to].any(axis=1) & (to[:, 1:] != to[:, :-1]).all(axis=1))
                if len(good):
                    break
                seed += len(self.TRIES)
            self.seeds[b] = seed + int(good[0])
            self.slots[own] = to = self._slot(names[own], self.TRIES[:1] + K.U64(self.seeds[b]))
            taken[to] = True
        single, free = np.flatnonzero(size == 1), np.flatnonzero(~taken)
        self.seeds[single] = -1 - free
        self.slots[order[start[single]]] = free

    def _bucket(self, names: np.ndarray) -> np.ndarray:
        return (K.mix(names ^ K.U64(0xB0C3)) % K.U64(self.buckets)).astype(np.int64)

    def _slot(self, names: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (K.mix(names + (seeds + K.U64(1)) * K.MULT) % K.U64(self.n)).astype(np.int64)

    def probe(self, names: np.ndarray) -> np.ndarray:
        seeds = self.seeds[self._bucket(names)]
        return np.where(seeds < 0, -1 - seeds, self._slot(names, np.maximum(seeds, 0).astype(np.uint64)))


def ragged(pool: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's pieces ``pick``, concatenated, and their lengths."""
    lens = (at[1:] - at[:-1])[pick]
    return pool[K.ranges(at[pick], lens)], lens


class Codec:
    """Encoder and decoder for one vocabulary; a worker builds it once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.data, self.at = np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        names = K.span_hashes(self.data, self.at[:-1], self.at[1:])
        self.hash = PerfectHash(names)
        self.entry = np.zeros(len(keys), np.int64)
        self.entry[self.hash.slots] = np.arange(len(keys))
        self.names, self.ids = names, np.fromiter(ranks.values(), np.int64, len(ranks))
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.memo: dict[bytes, list[int]] = {}
        self.memo_bytes = 0
        # by id, for decoding and for the decimal form
        most = int(self.ids.max()) + 1
        by_id: list[bytes] = [b""] * most
        for k, v in ranks.items():
            by_id[v] = k
        self.id_bytes, self.id_at = np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in by_id])])
        digits = [b"%d," % i for i in range(most)]
        self.dec_bytes, self.dec_at = np.frombuffer(b"".join(digits), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in digits])])

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
        prev = list(range(-1, n))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] - i != size:
                continue
            stop = end[i] = end[mid]
            end[mid] = 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop] - i))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a buffer, and their offsets by document."""
        starts, ends, at = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        names = K.span_hashes(data, starts, ends)
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        entry = self.entry[self.hash.probe(distinct)]
        size = self.at[entry + 1] - self.at[entry]
        whole = (self.names[entry] == distinct) & (size == e - s)
        hits = np.flatnonzero(whole)
        same = data[K.ranges(s[hits], size[hits])] == self.data[K.ranges(self.at[entry[hits]], size[hits])]
        if not same.all():
            whole[hits[np.repeat(np.arange(len(hits)), size[hits])[~same]]] = False
        lens = np.ones(len(distinct), np.int64)
        missed, merged = np.flatnonzero(~whole), []
        raw, memo = data.tobytes(), self.memo
        for i in missed.tolist():
            piece = raw[s[i] : e[i]]
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO or self.memo_bytes > MEMO_BYTES:
                    memo.clear()
                    self.memo_bytes = 0
                ids = memo[piece] = self.merge(piece)
                self.memo_bytes += len(piece) + 8 * len(ids)
            merged.append(ids)
        lens[missed] = [len(x) for x in merged]
        pool_at = np.concatenate([[0], np.cumsum(lens)])
        pool = np.zeros(pool_at[-1], np.int64)
        pool[pool_at[:-1][whole]] = self.ids[entry[whole]]
        pool[K.ranges(pool_at[:-1][missed], lens[missed])] = [x for ids in merged for x in ids]
        ids, lens = ragged(pool, pool_at, which)
        return ids, np.concatenate([[0], np.cumsum(lens)])[at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents' ids, and their offsets by document."""
        out, lens = ragged(self.id_bytes, self.id_at, ids)
        return out, np.concatenate([[0], np.cumsum(lens)])[at]

    def decimal(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by a comma."""
        out, lens = ragged(self.dec_bytes, self.dec_at, ids)
        return out, np.concatenate([[0], np.cumsum(lens)])[at]


_CODECS: dict[str, Codec] = {}


def codec(ranks_file: str, content: bytes) -> Codec:
    key = hashlib.sha256(content).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(content))
    return _CODECS[key]


def encode(docs: DataFrame, ranks_file: str, text: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = True, pattern: str = PATTERN) -> DataFrame:
    """Encode ``text`` of every row, decode the ids again, and return the columns ``keep`` with what was found.

    ids: a column token_ids (array of int) with them.  digests: columns n_tokens, ids_sha256, decoded_sha256 and
    round_trip (the decoded bytes are the text's).  The ranks file is read on the driver and broadcast; its size is
    the vocabulary's.  pattern: the tokenizer's, which has to be the one that this module splits by.
    """
    if pattern != PATTERN:
        raise ValueError(f"pre-tokens are found by {PATTERN!r}, not by {pattern!r}")
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    added = [pa.field("n_tokens", pa.int64())] + [pa.field("token_ids", pa.list_(pa.int32()))] * ids + [pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()), pa.field("round_trip", pa.bool_())] * digests
    types = {"int64": "long", "list<item: int32>": "array<int>", "string": "string", "bool": "boolean"}
    columns = [c for c in keep if c.lower() not in {f.name for f in added}]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"{f.name} {types[str(f.type)]}" for f in added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_file, shared.value)
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(len(columns)))
            for a, b in K.chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, by_doc = own.encode(part, at)
                out: list[pa.Array] = [pa.array(np.diff(by_doc))]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), pa.array(found.astype(np.int32))))
                if digests:
                    dec, dec_at = own.decimal(found, by_doc)
                    back, back_at = own.decode(found, by_doc)
                    dec, raw, src = dec.tobytes(), back.tobytes(), part.tobytes()
                    out.append(pa.array([hashlib.sha256(dec[x : max(x, y - 1)]).hexdigest() for x, y in zip(dec_at[:-1].tolist(), dec_at[1:].tolist())]))
                    spans = list(zip(back_at[:-1].tolist(), back_at[1:].tolist()))
                    out.append(pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in spans]))
                    out.append(pa.array([raw[x:y] == src[u:v] for (x, y), u, v in zip(spans, at[:-1].tolist(), at[1:].tolist())], pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(columns))] + out, names=columns + [f.name for f in added])

    return docs.select(*[docs[f"`{c}`"] for c in columns], docs[f"`{text}`"].alias(unused("__text", docs))).mapInArrow(work, schema)


def decode(rows: DataFrame, ranks_file: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The text of each row's ids, as binary column ``decoded`` (a cut text need not be UTF-8); null ids are empty.

    Rows do not depend on each other: repeated rows are decoded each, and there are no ties.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in (ids, "decoded")] if keep is None else keep
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["decoded binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_file, shared.value)
        for batch in batches:
            lists = batch.column(len(keep)).to_pylist()
            out = [bytes(own.decode(np.asarray(x or [], np.int64), np.array([0, len(x or [])]))[0]) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return rows.select(*[rows[f"`{c}`"] for c in keep], rows[f"`{ids}`"].alias(unused("__ids", rows))).mapInArrow(work, schema)
