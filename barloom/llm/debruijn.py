"""Operator 9: removal of repeated word spans by de Bruijn compaction.

A window is SPAN consecutive words of one document.  A word goes if it lies in a
window whose words also start in a document with a smaller id.

1. Edges.  Token k-mers of EDGE words become edges of a sparse de Bruijn graph: those
   whose name is the smallest in some window, so that every window has one and equal
   windows have the same.  Consecutive edges of a document are linked; a link's name
   covers all words from the first to the end of the second.
2. Repeated edges, those in two documents or more, with their smallest document.
3. Compaction.  Where every occurrence of an edge has the same next edge, and every
   occurrence of that one the same edge before, the link does not branch.  Paths of
   such links are compacted by joins that double the distance in each round, and
   each edge learns its path and its place in it.  All occurrences of a path are the same
   words, so the path's smallest document decides every window inside it.
4. Verification at the source coordinates.  Besides its name an edge has a check, a second
   name of another kind made from the words where it occurs.  An edge whose occurrences do
   not all have one check is on no path.  Windows whose smallest edge repeats but that reach
   over the end of a path, or lie on such an edge, are compared by name and check, 128
   bits, of their words where they start.

A chunk of documents holds each distinct edge and each distinct window once in what it
sends, however often they occur in it, and edges are combined map-side before they
meet, so an edge that a third of all documents have is no hot spot; joins on such an
edge may be split.

Null, empty and blank texts have no words.  A null doc_id sorts with the largest long,
after all others.  Rows with the same doc_id do not remove each other's words.  An empty
table gives an empty result; further columns are not looked at.  A very long text is a
chunk of its own, worked on whole in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from . import _kernels as K
from ._io import dropped, staged

SPAN, EDGE = 50, 20
WIDTH = SPAN - EDGE + 1
ROUNDS = 40
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NONE = np.int64(0)


class Tokens:
    """Words of a chunk, its edges and the links between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.at = K.word_spans(data, offsets)
        w = K.span_hashes(data, self.starts, self.ends)
        n = self.n = len(w)
        double = lambda x, by: K.pair(x[: len(x) - by], x[by:]) if len(x) > by else x[:0]
        self.h2 = double(w, 1)
        h4 = double(self.h2, 2)
        h8 = double(h4, 4)
        self.h16 = double(h8, 8)
        self.h32 = double(self.h16, 16)
        edge = K.pair(self.h16[: max(0, n - EDGE + 1)], h4[16:]) if n >= EDGE else w[:0]
        size = np.diff(self.at)
        self.ok = np.zeros(n, bool)  # a window starts here
        self.ok[K.ranges(self.at[:-1], np.maximum(size - SPAN + 1, 0))] = True
        self.edges, self.floor = C.minimizers(edge, self.ok, WIDTH) if n >= SPAN else (np.zeros(0, np.int64), np.zeros(0, K.U64))
        self.names = edge[self.edges]
        self.distinct, self.which = np.unique(self.names, return_inverse=True)
        self.doc = np.searchsorted(self.at, self.edges, "right") - 1

    @cached_property
    def checks(self) -> K.Checks:
        return K.Checks.of_words(self.data, self.starts)

    def links(self) -> np.ndarray:
        """Names of links to the next edge of the same document; 0: none."""
        m = len(self.edges)
        out = np.zeros(m, K.U64)
        if m > 1:
            gap = np.diff(self.edges)
            # edges further apart than a window are not joined
            near = np.flatnonzero((self.doc[1:] == self.doc[:-1]) & (gap <= WIDTH))
            name = K.pair(K.pair(self.names[near], self.names[near + 1]), gap[near].astype(K.U64))
            far = np.flatnonzero(gap[near] > EDGE)
            name[far] = K.pair(name[far], self.h32[np.minimum(self.edges[near[far]], len(self.h32) - 1)])
            out[near] = K.pair(name, self.checks.between(self.edges[near], self.edges[near + 1] + EDGE)) | K.U64(1)
        return out

    def windows(self, at: np.ndarray, ids: np.ndarray) -> Windows:
        """The distinct windows that start at these words."""
        return Windows(K.pair(K.pair(self.h32[at], self.h16[at + 32]), self.h2[at + 48]), self.checks.between(at, at + SPAN), ids[np.searchsorted(self.at, at, "right") - 1])


class Windows:
    """Distinct (name, check) of some windows, the smallest and largest document of each, and which one each window is."""

    def __init__(self, name: np.ndarray, check: np.ndarray, doc: np.ndarray):
        order = np.lexsort((doc, check, name))
        n, c, d = name[order], check[order], doc[order]
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        self.name, self.check, self.lo = n[first], c[first], d[first]
        self.hi = d[np.append(first[1:], len(n)) - 1] if len(n) else d
        self.which = np.empty(len(n), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.doc = doc


def edge_rows(chunks: DataFrame) -> DataFrame:
    """One row per edge occurrence: name, check, chunk, ordinal among the chunk's distinct edges, whether it is the first of those, document, links before and after, next edge."""

    def work(chunk, ids, data, offsets) -> Iterator[pa.RecordBatch]:
        t = Tokens(data, offsets)
        m, link = len(t.edges), t.links()
        before, after = np.zeros(m, K.U64), np.zeros(m, K.U64)
        before[1:] = link[:-1]
        after[:-1] = np.where(link[:-1] > 0, t.names[1:], K.U64(0))
        gap = np.zeros(m, np.int32)
        gap[:-1] = np.where(link[:-1] > 0, np.diff(t.edges), 0)
        lead = np.zeros(m, bool)
        lead[np.unique(t.which, return_index=True)[1]] = True
        check = t.checks.between(t.edges, t.edges + EDGE).view(np.int64)
        cols = [t.names.view(np.int64), check, np.full(m, chunk), t.which.astype(np.int32), lead, ids[t.doc], link.view(np.int64), before.view(np.int64), after.view(np.int64), gap]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["edge", "check", "chunk", "nth", "lead", "doc", "link", "before", "after", "gap"])

    return C.each_chunk(chunks, work, "edge long, check long, chunk long, nth int, lead boolean, doc long, link long, before long, after long, gap int")


def repeated(rows: DataFrame) -> DataFrame:
    """edge, first_doc, and its only link, next edge, gap and link before where all its occurrences agree, in their words too."""
    low = [F.min(c).alias(f"{c}_lo") for c in ("doc", "check", "link", "before", "after", "gap")]
    high = [F.max(c).alias(f"{c}_hi") for c in ("doc", "check", "link", "before")]
    found = rows.groupBy("edge").agg(*low, *high).where("doc_lo < doc_hi")
    sure = F.col("check_lo") == F.col("check_hi")
    only = lambda c, cond: F.when(sure & (F.col(f"{cond}_lo") == F.col(f"{cond}_hi")) & (F.col(f"{cond}_lo") != int(NONE)), F.col(f"{c}_lo"))
    return found.select("edge", F.col("doc_lo").alias("first_doc"), only("link", "link").alias("link"), only("after", "link").alias("after"), only("gap", "link").alias("gap"), only("before", "before").alias("before"))


def compacted(edges: DataFrame) -> DataFrame:
    """edge, path, place: the first edge of its nonbranching path, and the words from there to it."""
    spark = edges.sparkSession
    a, b = edges.select(F.col("edge").alias("up"), "link", "after", "gap").where("link is not null"), edges.where("before is not null").select("edge", "before")
    step = staged(a.join(b, (F.col("after") == F.col("edge")) & (F.col("link") == F.col("before"))).select("edge", "up", F.col("gap").cast("long").alias("place")), "paths")
    # an edge that follows none is the head of its path; whole: the pointer has reached the head
    later = step.select(F.col("edge").alias("__e"))
    now = staged(step.join(later, F.col("up") == F.col("__e"), "left").select("edge", "up", "place", F.col("__e").isNull().alias("whole")), "paths")
    dropped(spark, step)
    for _ in range(ROUNDS):
        if now.where("not whole").isEmpty():
            break
        far = now.select(F.col("edge").alias("__e"), F.col("up").alias("__up"), F.col("place").alias("__place"), F.col("whole").alias("__whole"))
        jumped = now.where("not whole").join(far, F.col("up") == F.col("__e")).select("edge", F.col("__up").alias("up"), (F.col("place") + F.col("__place")).alias("place"), F.col("__whole").alias("whole"))
        after = staged(now.where("whole").unionByName(jumped), "paths")
        dropped(spark, now)
        now = after
    else:
        raise RuntimeError(f"paths did not settle in {ROUNDS} rounds")
    found = now.select(F.col("edge").alias("__d"), F.col("up").alias("path"), "place")
    return edges.select("edge", "first_doc").join(found, F.col("edge") == F.col("__d"), "left").select("edge", "first_doc", F.coalesce("path", "edge").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))


def marked(t: Tokens, ids: np.ndarray, marks: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """A mask of words that paths decide, and the starts of windows that have to be compared by name."""
    m = len(t.edges)
    gone = np.zeros(t.n, bool)
    if not m or not marks:
        return gone, np.zeros(0, np.int64)
    nth = np.array([x["nth"] for x in marks], np.int64)
    rep, first, path, place = np.zeros(len(t.distinct), bool), *np.zeros((3, len(t.distinct)), np.int64)
    rep[nth] = True
    first[nth], path[nth], place[nth] = ([x[c] for x in marks] for c in ("first_doc", "path", "place"))
    rep, first, path, place = (x[t.which] for x in (rep, first, path, place))
    # runs of edges that follow each other on one path
    joined = np.zeros(m, bool)
    joined[1:] = rep[1:] & rep[:-1] & (t.doc[1:] == t.doc[:-1]) & (path[1:] == path[:-1]) & (place[1:] - place[:-1] == np.diff(t.edges))
    head = np.flatnonzero(rep & ~joined)
    run = np.cumsum(rep & ~joined) - 1
    tail = np.zeros(len(head), np.int64)
    np.maximum.at(tail, run[rep], np.flatnonzero(rep))
    lo, hi = t.edges[head], t.edges[tail] + EDGE
    inside = np.zeros(t.n, bool)  # windows that lie inside a run
    inside[K.ranges(lo, np.maximum(hi - lo - SPAN + 1, 0))] = True
    dup = (first[head] < ids[t.doc[head]]) & (hi - lo >= SPAN)
    gone[K.ranges(lo[dup], (hi - lo)[dup])] = True
    # other windows whose smallest edge repeats; that one is an edge in every document that has the window
    s = np.flatnonzero(t.ok & ~inside)
    s = s[np.isin(t.floor[s], np.unique(t.names[rep]))]
    return gone, s


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; kept_text: also the remaining words."""
    chunks = C.chunked(docs, text, doc_id)
    rows = edge_rows(chunks)
    edges = staged(repeated(rows), "edges")
    paths = staged(compacted(edges), "edge-paths")
    places = rows.where("lead").select("edge", "chunk", "nth").join(paths.withColumnRenamed("edge", "__edge"), F.col("edge") == F.col("__edge"))
    marks = places.groupBy(F.col("chunk").alias("__m")).agg(F.collect_list(F.struct("nth", "first_doc", "path", "place")).alias("marks"))
    marks = staged(marks, "edge-marks")
    dropped(docs.sparkSession, edges, paths)
    both = chunks.join(marks, F.col("chunk") == F.col("__m"), "left").select("chunk", "ids", "offsets", "body", "marks")

    def compare(chunk, ids, data, offsets, marks) -> Iterator[pa.RecordBatch]:
        t = Tokens(data, offsets)
        w = t.windows(marked(t, ids, marks)[1], ids)
        n = len(w.name)
        cols = [w.name.view(np.int64), w.check.view(np.int64), w.lo, w.hi, np.full(n, chunk), np.arange(n, dtype=np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["window", "check", "lo", "hi", "chunk", "nth"])

    windows = staged(C.each_chunk(both, compare, "window long, check long, lo long, hi long, chunk long, nth int"), "edge-windows")
    least = windows.groupBy(F.col("window").alias("__w"), F.col("check").alias("__c")).agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last")
    again = windows.join(least, (F.col("window") == F.col("__w")) & (F.col("check") == F.col("__c")) & (F.col("first") < F.col("hi")))
    again = again.groupBy(F.col("chunk").alias("__s")).agg(F.collect_list(F.struct("nth", "first")).alias("again"))
    everything = both.join(again, F.col("chunk") == F.col("__s"), "left").select("chunk", "ids", "offsets", "body", "marks", "again")

    def finish(chunk, ids, data, offsets, marks, again) -> Iterator[pa.RecordBatch]:
        t = Tokens(data, offsets)
        order = np.asarray(ids.fill_null(C.NULL_ID))
        gone, s = marked(t, order, marks)
        if again:
            w = t.windows(s, order)
            first = np.full(len(w.name), C.NULL_ID)
            first[[x["nth"] for x in again]] = [x["first"] for x in again]
            s = s[first[w.which] < w.doc]
            edge = np.zeros(t.n + 1, np.int32)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + SPAN, -1)
            gone |= np.cumsum(edge[:-1]) > 0
        keep = np.flatnonzero(~gone)
        size = t.ends[keep] - t.starts[keep]
        # each kept word with a space after it
        out = np.full(int(size.sum()) + len(keep), 0x20, np.uint8)
        to = np.concatenate([[0], np.cumsum(size + 1)])
        out[K.ranges(to[:-1], size)] = data[K.ranges(t.starts[keep], size)]
        at = to[np.searchsorted(keep, t.at)].tolist()
        raw = out.tobytes()
        rest = [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[t.at])
        cols = [ids, pa.array(np.diff(t.at)), pa.array(lost), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(rest, pa.binary())] * kept_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * kept_text)

    return C.each_chunk(everything, finish, OUT + ", kept binary" * kept_text, nulls=True)
