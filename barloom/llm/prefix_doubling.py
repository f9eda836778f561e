"""Operator 8: removal of repeated substrings by distributed prefix doubling.

Documents are bytes.  A byte goes if it lies in a string of LENGTH bytes that also
starts earlier: in a document with a smaller id, or earlier in the same one.

Positions are ranked by names of growing prefixes: the name of a prefix of 2L bytes
at i is that of the pair (name of L bytes at i, name of L bytes at i + L), for L = 1,
2, 4, ... 32.  Only positions that can decide are sorted across documents: the
anchors, where the 32-byte name is the smallest among those of some LENGTH-byte
string (equal strings have equal anchors).  Then the rounds rerank what is left:

1. 32-byte prefixes at the anchors; an anchor with a unique name is done,
2. pairs of that name and the name of all bytes that a LENGTH-byte string through the
   anchor can reach: a pair that starts earlier elsewhere decides all strings through
   the anchor (past the threshold), a prefix with a single such pair needs no more,
3. strings of LENGTH bytes themselves, at the few anchors that are still undecided.

In each round Spark moves the names to the buckets that own them, where they are
sorted; a name occurs there once for each chunk of documents that has it, so a
passage that a third of all documents hold is no hot spot.  Every name goes with a
check, a second name of another kind made from the same bytes where they stand, and
only rows that agree in both, 96 bits, count as equal.  A bucket holds the names of
about BUCKET_BYTES of compressed texts, however large the input is.

Null and empty texts have no bytes.  A null doc_id sorts with the largest long, after
all others.  Rows with the same doc_id count as one document's: of equal strings at
equal offsets both stay.  Matches never cross rows.  An empty table gives an empty
result; further columns are not looked at.  A very long text is a chunk of its own, named
whole in one task, whose memory is some 70 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from . import _kernels as K
from ._io import partitions, staged

LENGTH, SEED = 100, 32
WIDTH = LENGTH - SEED + 1
BEFORE = LENGTH - SEED
BUCKET_BYTES = 16 << 20

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Ranks:
    """Names of prefixes at every byte of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        w = np.zeros(n, K.U64)
        w[:] = data
        size = 1
        while size < 8:
            nxt = w.copy()
            nxt[: n - size] |= w[size:] << K.U64(8 * size)
            w, size = nxt, size * 2
            if size == 4:
                self.w4 = w
        self.h16 = self._double(w, 8)
        self.h32 = self._double(self.h16, 16)
        self.data, self.offsets, self.n = data, offsets, n
        doc_size = np.diff(offsets)
        self.ok = np.zeros(n, bool)  # a string of LENGTH bytes starts here
        self.ok[K.ranges(offsets[:-1], np.maximum(doc_size - LENGTH + 1, 0))] = True
        self.anchors, self.floor = C.minimizers(self.h32, self.ok, WIDTH) if n >= LENGTH else (np.zeros(0, np.int64), np.zeros(0, K.U64))
        self.names = self.h32[self.anchors]
        self.checks = K.Checks.of_bytes(data)
        self.doc = np.searchsorted(offsets, self.anchors, "right") - 1

    @staticmethod
    def _double(x: np.ndarray, by: int) -> np.ndarray:
        return K.pair(x[: len(x) - by], x[by:]) if len(x) > by else x[:0]

    def check(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.checks.between(start, end).astype(np.uint32)

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Names of the LENGTH bytes at each place."""
        h64 = K.pair(self.h32[at], self.h32[at + 32])
        return K.pair(K.pair(h64, self.h32[at + 64]), self.w4[at + 96] & K.U64(0xFFFFFFFF))

    def reach(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of all bytes that strings through the anchors can reach."""
        left, right = np.maximum(at - BEFORE, self.offsets[doc]), np.minimum(at + LENGTH, self.offsets[doc + 1])
        full = (at - left == BEFORE) & (right - at == LENGTH)
        out = np.zeros(len(at), K.U64)
        f = at[full]
        before = K.pair(K.pair(self.h32[f - 68], self.h32[f - 36]), self.w4[f - 4] & K.U64(0xFFFFFFFF))
        out[full] = K.pair(before, self.strings(f))
        raw = self.data.tobytes() if not full.all() else b""
        for i in np.flatnonzero(~full).tolist():
            body = raw[left[i] : right[i]] + int(at[i] - left[i]).to_bytes(2, "little")
            out[i] = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
        return out, self.check(left, right) ^ (at - left).astype(np.uint32)


def firsts(names: tuple[np.ndarray, ...], *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the first row, by place, of each distinct combination of names (in order), and which of those each row has."""
    order = np.lexsort((*place[::-1], *names[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in names:
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def distinct(key: np.ndarray, names: tuple[np.ndarray, ...], *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As firsts(names, *place), in the order of key, a name of all names, where rows come in the order of place."""
    for i in range(len(place)):
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in place[:i]]) if i else True
        if (same & (place[i][1:] < place[i][:-1])).any():
            return firsts((key, *names), *place)
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    for x in names:
        s = x[order]
        if (~new[1:] & (s[1:] != s[:-1])).any():  # one key for two
            return firsts((key, *names), *place)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return (np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order), which


def repeated(asker: np.ndarray, names: np.ndarray, checks: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """1 if a name occurs more than once anywhere."""
    _, which = firsts((names, checks))
    count = np.bincount(which)
    flagged = np.bincount(which, twice, minlength=len(count)) > 0
    return ((count > 1) | flagged)[which]


def decided(asker: np.ndarray, names: np.ndarray, reach: np.ndarray, checks: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Bit 0: the same reach starts earlier elsewhere; bit 1: the prefix has several reaches."""
    first, which = firsts((names, reach, checks), ids, pos)
    f_id, f_pos = ids[first][which], pos[first][which]
    earlier = (f_id < ids) | ((f_id == ids) & (f_pos < pos))
    _, own = np.unique(names[first], return_inverse=True)
    several = np.bincount(own)[own][which] > 1
    return earlier.astype(np.uint8) | several.astype(np.uint8) << 1


def started(asker: np.ndarray, names: np.ndarray, checks: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """1 if the same string starts earlier elsewhere."""
    first, which = firsts((names, checks), ids, pos)
    f_id, f_pos = ids[first][which], pos[first][which]
    return (f_id < ids) | ((f_id == ids) & (f_pos < pos))


def first_round(r: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names and checks of anchors, whether each occurs twice here, and which one each anchor has."""
    checks = r.check(r.anchors, r.anchors + SEED)
    first, which = distinct(r.names, (checks,))
    return r.names[first], checks[first], (np.bincount(which) > 1).astype(np.uint8), which


def second_round(r: Ranks, ids: np.ndarray, said: list[dict] | None, buckets: int):
    """Repeated anchors; the distinct (name, reach, check) among them with their earliest place; which one each has."""
    names, _, _, which = first_round(r)
    rep = np.flatnonzero(C.heard(names, buckets, said)[which])
    at, doc = r.anchors[rep], r.doc[rep]
    reach, checks = r.reach(at, doc)
    pos = at - r.offsets[doc]
    first, own = distinct(K.pair(r.names[rep], reach), (r.names[rep], reach, checks), ids[doc], pos)
    return at, doc, first, own, r.names[rep][first], reach[first], checks[first], ids[doc][first], pos[first]


def third_round(r: Ranks, ids: np.ndarray, said1: list[dict] | None, said2: list[dict] | None, buckets: int):
    """A mask of bytes that round two removes; undecided strings: places, distinct names and checks with earliest place, which."""
    at, doc, first, own, names, *_ = second_round(r, ids, said1, buckets)
    # questions of one name stand together in their bucket in the order asked
    bits = C.heard(names, buckets, said2)[own]
    is_first = np.zeros(len(at), bool)
    is_first[first] = True
    dup = ~is_first | (bits & 1 > 0)
    gone = np.zeros(r.n + 1, np.int32)
    d_at, d_doc = at[dup], doc[dup]
    lo, hi = np.maximum(d_at - BEFORE, r.offsets[d_doc]), np.minimum(d_at, r.offsets[d_doc + 1] - LENGTH)
    good = hi >= lo
    np.add.at(gone, lo[good], 1)
    np.add.at(gone, hi[good] + LENGTH, -1)
    live = ~dup & (bits & 2 > 0)
    l_at, l_doc = at[live], doc[live]
    lo, hi = np.maximum(l_at - BEFORE, r.offsets[l_doc]), np.minimum(l_at, r.offsets[l_doc + 1] - LENGTH)
    count = np.maximum(hi - lo + 1, 0)
    s = K.ranges(lo, count)
    s = np.unique(s[r.floor[s] == np.repeat(r.h32[l_at], count)])
    s_doc = np.searchsorted(r.offsets, s, "right") - 1
    name, check, pos = r.strings(s), r.check(s, s + LENGTH), s - r.offsets[s_doc]
    first, own = distinct(name, (check,), ids[s_doc], pos)
    return np.cumsum(gone[:-1]) > 0, s, name[first], check[first], first, own, ids[s_doc][first], pos[first]


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; kept_text: also the remaining bytes."""
    spark = docs.sparkSession
    chunks = C.chunked(docs, text, doc_id)
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-size // BUCKET_BYTES))

    def ask1(chunk, ids, data, offsets) -> Iterator[pa.RecordBatch]:
        names, checks, twice, _ = first_round(Ranks(data, offsets))
        yield from C.questions(chunk, names, buckets, checks, twice)

    said1 = staged(C.answers(C.each_chunk(chunks, ask1, C.question_schema(2)), repeated, [np.uint32, np.uint8]), "ranks-1")

    def ask2(chunk, ids, data, offsets, said) -> Iterator[pa.RecordBatch]:
        _, _, _, _, names, reach, checks, first_id, first_pos = second_round(Ranks(data, offsets), ids, said, buckets)
        yield from C.questions(chunk, names, buckets, reach, checks, first_id, first_pos.astype(np.int64))

    asked = C.each_chunk(C.with_answers(chunks, said1), ask2, C.question_schema(4))
    said2 = staged(C.answers(asked, decided, [K.U64, np.uint32, np.int64, np.int64]), "ranks-2")

    def ask3(chunk, ids, data, offsets, said_1, said_2) -> Iterator[pa.RecordBatch]:
        _, _, names, checks, _, _, first_id, first_pos = third_round(Ranks(data, offsets), ids, said_1, said_2, buckets)
        yield from C.questions(chunk, names, buckets, checks, first_id, first_pos.astype(np.int64))

    asked = C.each_chunk(C.with_answers(chunks, said1, said2), ask3, C.question_schema(3))
    said3 = staged(C.answers(asked, started, [np.uint32, np.int64, np.int64]), "ranks-3")

    def finish(chunk, ids, data, offsets, said_1, said_2, said_3) -> Iterator[pa.RecordBatch]:
        r = Ranks(data, offsets)
        gone, s, names, _, first, own, _, _ = third_round(r, np.asarray(ids.fill_null(C.NULL_ID)), said_1, said_2, buckets)
        is_first = np.zeros(len(s), bool)
        is_first[first] = True
        s = s[~is_first | (C.heard(names, buckets, said_3)[own] > 0)]
        edge = np.zeros(r.n + 1, np.int32)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + LENGTH, -1)
        gone |= np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < r.n]] |= gone[offsets[:-1][offsets[:-1] < r.n]]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        left = data[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
        rest = [left[a:b] for a, b in zip(at[:-1], at[1:])]
        cols = [ids, pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(begins)), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
        names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(rest, pa.binary())] * kept_text, names=names_ + ["kept"] * kept_text)

    return C.each_chunk(C.with_answers(chunks, said1, said2, said3), finish, OUT + ", kept binary" * kept_text, nulls=True)
