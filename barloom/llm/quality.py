"""Operator 6: quality classifier.

Document statistics (character classes, word and line shapes, repetition) are
standardised and mapped by random Fourier features, which approximate a Gaussian
kernel.  Every partition sums its own normal equations; the sums meet in a tree of
FAN_IN sums a node and the driver solves one ridge system of fixed size.  Scores of rows held
out from their own fold are then calibrated by isotonic regression on a fixed
number of bins.

Only the text is an input.  Labels are learned only from rows whose
crc32(doc_id as text) mod 3 is not 1.  All labelled rows outside that fold are
used; none are sampled.

Nulls: a null text is empty; null labels are skipped; several labels of a row all
count; a row with a null doc_id is never learned from.  Empty texts get a score like any other.
Without any label every score is 0.5.  Repeated rows are scored alike.  A very long
text is measured whole, as a batch of its own.  An empty
table gives an empty result; further columns are not looked at, and pass through
accepted() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import ship, staged

WIDTH, RIDGE, SEED, FOLDS, BINS = 256, 1e-3, 6, 3, 2048
HELD_OUT_OF, HELD_OUT = 3, 1
#: Sums that one task of pooled() adds up.
FAN_IN = 64

#: Classes of bytes: 0 control, 1 blank, 2 newline, 3 lower, 4 upper, 5 digit, 6 stop, 7 pause, 8 exclamation, 9 mark, 10 other punctuation, 11 non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[0x0A] = 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 3, 4, 5
_CLASS[[33, *range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 10
_CLASS[[ord(".")]], _CLASS[[ord(","), ord(";"), ord(":")]], _CLASS[[ord("!"), ord("?")]] = 6, 7, 8
_CLASS[[ord(c) for c in "#$%&*|@^~+=<>_\\/{}[]"]] = 9
_CLASS[128:] = 11
CLASSES = 12
N_FEATURES = CLASSES - 1 + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    share = kinds[:, 1:] / np.maximum(size, 1)[:, None]

    starts, ends, at = K.word_spans(data, offsets)
    names = K.span_hashes(data, starts, ends)
    words = np.diff(at)
    w_doc = np.repeat(np.arange(n), words)
    per = lambda x: np.bincount(w_doc, x, minlength=n) / np.maximum(words, 1)
    lens = (ends - starts).astype(float)
    mean = per(lens)
    spread = np.sqrt(np.maximum(per(lens * lens) - mean * mean, 0))
    last, first = _CLASS[data[ends - 1]], _CLASS[data[starts]]
    distinct = distinct_share(w_doc, names, words, n)

    newline = data == 0x0A
    l_starts = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(newline) + 1]))
    l_starts = l_starts[l_starts < len(data)]
    l_ends = np.append(l_starts[1:], len(data))
    l_doc = np.searchsorted(offsets, l_starts, "right") - 1
    lines = np.bincount(l_doc, minlength=n)
    cum = np.concatenate([np.zeros(1, K.U64), np.cumsum(names * K.MULT)])
    w_at = np.searchsorted(starts, np.append(l_starts, len(data)))
    line_hash = K.mix(cum[w_at[1:]] - cum[w_at[:-1]])
    line_share = distinct_share(l_doc, line_hash, lines, n)
    line_words = words / np.maximum(lines, 1)
    caps = per(((first == 4) & (last != 3) & (lens > 1)).astype(float))
    return np.column_stack(
        [
            share, np.log1p(size), np.log1p(words), mean, spread, distinct, line_share, np.log1p(line_words),
            per((lens <= 3).astype(float)), per((last == 9).astype(float)), per((last == 8).astype(float)), caps,
            per(((first == 9) & (lens == 1)).astype(float)), per((lens > 20).astype(float)),
        ]
    )


def distinct_share(doc: np.ndarray, names: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Distinct names over names, by document; 1 where there are none."""
    if not len(names):
        return np.ones(n)
    key = np.sort(K.pair(names, doc.astype(K.U64)) >> K.U64(20) | doc.astype(K.U64) << K.U64(44))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    got = np.bincount((key[new] >> K.U64(44)).astype(np.int64), minlength=n)
    return np.where(counts > 0, got / np.maximum(counts, 1), 1.0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return fourier(self.standard(x)) @ weights

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x, self.weights), self.knots, self.values)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of width sqrt(d), with a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], WIDTH)) / np.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * np.pi, WIDTH)
    return np.column_stack([np.cos(x @ w + b) * np.sqrt(2 / WIDTH), np.ones(len(x))])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(True))


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and x, its statistics, for every row."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for a, b in K.chunks(offsets):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], names=["doc_id", "x"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, "doc_id long, x array<float>")


def matrix(column: pa.Array, width: int = N_FEATURES) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def pooled(df: DataFrame, blobs: list[str]) -> list[np.ndarray]:
    """Sum equally shaped double arrays, one row a partition, by a tree; one row reaches the driver."""
    names = [x.split()[0] for x in blobs]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                got = [np.frombuffer(x) for x in row]
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=names)

    schema = ", ".join(f"{x} binary" for x in names)
    left = df.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        df = df.repartition(left).mapInArrow(add, schema)
    rows = df.mapInArrow(add, schema).collect()
    return [np.frombuffer(rows[0][x]) for x in names] if rows else []


def train(feats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Model:
    """Fit on the labelled rows outside the held-out fold; feats as features() returns, best staged."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((3, N_FEATURES))
        for batch in batches:
            x = matrix(batch.column(0))
            s += np.stack([np.full(N_FEATURES, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    got = pooled(feats.select("x").mapInArrow(moments, "s binary"), ["s"])
    n, s, ss = got[0].reshape(3, -1) if got else np.zeros((3, N_FEATURES))
    mean = s / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(ss / np.maximum(n, 1) - mean * mean, 1e-8))
    model = Model(mean, scale, None, np.array([0.0]), np.array([0.5]))

    marks = labels.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null")
    marks = marks.groupBy("__id").agg(F.sum("y").alias("ys"), F.count("y").cast("double").alias("yn"))
    rows = feats.where(~held_out()).join(marks, F.col("doc_id") == F.col("__id")).select("x", "ys", "yn", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = staged(rows, "quality-train")
    width = WIDTH + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for batch in batches:
            z = fourier(model.standard(matrix(batch.column(0))))
            ys, yn, fold = (np.asarray(batch.column(i), float) for i in (1, 2, 3))
            for f in range(FOLDS):
                own = fold == f
                a[f] += (z[own] * yn[own, None]).T @ z[own]
                b[f] += z[own].T @ ys[own]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    got = pooled(rows.mapInArrow(equations, "a binary, b binary"), ["a", "b"])
    if not got or not got[0].any():
        return model
    a, b = got[0].reshape(FOLDS, width, width), got[1].reshape(FOLDS, width)

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + RIDGE * max(a[-1, -1], 1.0) / WIDTH * np.eye(width), b)

    model.weights = solve(a.sum(0), b.sum(0))
    others = np.stack([solve(a.sum(0) - a[f], b.sum(0) - b[f]) for f in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((3, BINS))
        for batch in batches:
            ys, yn, fold = (np.asarray(batch.column(i), float) for i in (1, 2, 3))
            raw = (fourier(model.standard(matrix(batch.column(0)))) * others[fold.astype(int)]).sum(1)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for i, x in enumerate((yn, ys, raw * yn)):
                s[i] += np.bincount(at, x, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    n, ys, raw = pooled(rows.mapInArrow(binned, "s binary"), ["s"])[0].reshape(3, BINS)
    model.knots, model.values = isotonic(raw[n > 0] / n[n > 0], ys[n > 0] / n[n > 0], n[n > 0])
    return model


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the blocks' mean x and value, x increasing."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    got = np.array(blocks)
    return got[:, 0] / got[:, 2], np.clip(got[:, 1] / got[:, 2], 0, 1)


def scores(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of features()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(matrix(batch.column(2))))], names=["doc_id", "held_out", "score"])

    rows = feats.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(work, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    feats = staged(features(docs, text, doc_id), "quality-features")
    return scores(feats, train(feats, labels))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5, with all their columns; the texts are not shuffled."""
    model = train(staged(features(docs, text, doc_id), "quality-features"), labels, doc_id="doc_id")
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(at))
            for a, b in K.chunks(offsets):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                # as the features of scores() are: single precision
                good = model.score(x.astype(np.float32).astype(float)) >= 0.5
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
