"""Chunks of documents as rows, and questions that chunks put to buckets of names.

A chunk row holds some MB of documents, compressed, so that a pass over the texts
moves a third of their size and costs no row work.  A pass names substrings of a
chunk by 64-bit hashes and asks, once for each distinct name, the bucket that owns
it; a bucket sees a name at most once from each chunk, however often it occurs,
and answers with one byte for each name asked, in the order asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import ship, staged

CHUNK = "chunk long, ids binary, offsets binary, body binary"
#: Where a null doc_id stands in the order of documents: with the largest long, after all others.
NULL_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame, text: str, doc_id: str, most: int = K.CHUNK_BYTES) -> DataFrame:
    """The documents as chunk rows, written to the shared folder."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=3)
        at = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal at
            ids = np.concatenate([h[0] for h in held]).tobytes() + np.packbits(np.concatenate([h[3] for h in held])).tobytes()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))]).astype(np.int64)
            body = squeeze.compress(np.concatenate([h[1] for h in held]).tobytes())
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at - 1])] + [pa.array([x], pa.binary()) for x in (ids, offsets.tobytes(), body)], names=["chunk", "ids", "offsets", "body"])

        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            ids, nulls = np.asarray(batch.column(0).fill_null(NULL_ID)), np.asarray(batch.column(0).is_null())
            for a, b in K.chunks(offsets, most):
                held.append((ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], nulls[a:b]))
                size += len(held[-1][1])
                if size >= most // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return staged(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, CHUNK), "chunks")


def opened(ids: bytes, offsets: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, bytes, offsets and null ids of a chunk row."""
    import zstandard

    at = np.frombuffer(offsets, np.int64)
    n = len(at) - 1
    nulls = np.unpackbits(np.frombuffer(ids, np.uint8, offset=8 * n), count=n).astype(bool)
    return np.frombuffer(ids, np.int64, n), np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), at, nulls


def each_chunk(df: DataFrame, work: Callable[..., Iterator[pa.RecordBatch] | None], schema: str, nulls: bool = False) -> DataFrame:
    """work(chunk, ids, data, offsets, *other columns) for each row of a table that begins with the columns of CHUNK.

    nulls: the ids are an Arrow array with its nulls instead of numbers alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = [batch.column(c)[i].as_py() for c in range(batch.num_columns)]
                ids, data, offsets, null = opened(*row[1:4])
                yield from work(row[0], pa.array(ids, mask=null) if nulls else ids, data, offsets, *row[4:])

    return df.mapInArrow(run, schema)


def packed(x: np.ndarray) -> bytes:
    """The values' bytes; of int64, ids and places with many zero bytes, plane by plane, so that they compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() if x.dtype == np.int64 else x.tobytes()


def unpacked(blobs: list[bytes], kind: type) -> np.ndarray:
    """The values of several packed() pieces, one after the other."""
    if kind is not np.int64:
        return np.frombuffer(b"".join(blobs), kind)
    planes = [np.frombuffer(b, np.uint8).reshape(8, -1) for b in blobs]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(np.int64).ravel() if planes else np.zeros(0, np.int64)


def questions(chunk: int, names: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the names (distinct, in order) and what goes with them."""
    bucket = (K.mix(names ^ K.U64(0xC0DE)) % K.U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    blobs = [[packed(x[order[cut[b] : cut[b + 1]]]) for b in full] for x in (names, *more)]
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk))] + [pa.array(b, pa.binary()) for b in blobs], names=["bucket", "chunk", "names", *[f"x{i}" for i in range(len(more))]])


def question_schema(more: int) -> str:
    return "bucket int, chunk long, names binary" + "".join(f", x{i} binary" for i in range(more))


def answers(asked: DataFrame, resolve: Callable[..., np.ndarray], types: list) -> DataFrame:
    """chunk, answers (array of bucket and bytes): resolve(asker, names, *more) gives a byte for each name of a bucket."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        chunk = np.asarray(table.column("chunk"))
        blobs = [table.column(i).to_pylist() for i in range(2, table.num_columns)]
        lens = np.array([len(b) // 8 for b in blobs[0]])
        parts = [unpacked(b, t) for b, t in zip(blobs, [K.U64, *types])]
        got = resolve(np.repeat(np.arange(len(chunk)), lens), *parts).astype(np.uint8)
        cut = np.concatenate([[0], np.cumsum(lens)])
        return pa.table({"chunk": pa.array(chunk), "bucket": pa.array(np.full(len(chunk), key[0].as_py(), np.int32)), "said": pa.array([got[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    said = asked.groupBy("bucket").applyInArrow(work, "chunk long, bucket int, said binary")
    return said.groupBy(F.col("chunk").alias("__chunk")).agg(F.collect_list(F.struct("bucket", "said")).alias("answers"))


def heard(names: np.ndarray, buckets: int, said: list[dict] | None) -> np.ndarray:
    """The answers in the order of the names asked with questions()."""
    out = np.zeros(len(names), np.uint8)
    if said:
        bucket = (K.mix(names ^ K.U64(0xC0DE)) % K.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out[order] = np.frombuffer(b"".join(s["said"] for s in sorted(said, key=lambda s: s["bucket"])), np.uint8)
    return out


def with_answers(chunks: DataFrame, *said: DataFrame) -> DataFrame:
    """Chunk rows with one column of answers for each round."""
    out = chunks
    for i, s in enumerate(said):
        out = out.join(s.select(F.col("__chunk").alias(f"__c{i}"), F.col("answers").alias(f"answers{i}")), F.col("chunk") == F.col(f"__c{i}"), "left")
    return out.select("chunk", "ids", "offsets", "body", *[f"answers{i}" for i in range(len(said))])


def sliding(op: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    if len(x) > 2 * K.BLOCK + width:
        whole = np.empty(len(x) - width + 1, x.dtype)
        for i in range(0, len(whole), K.BLOCK):
            whole[i : i + K.BLOCK] = sliding(op, x[i : i + K.BLOCK + width - 1], width)
        return whole
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


def minimizers(names: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors, and the smallest name of each window.

    names: of the k-mer at each place.  starts: whether a window of ``width`` k-mers starts there (within one
    document).  An anchor is a place whose name is the smallest of some window.  Equal windows have their anchors
    at equal places.
    """
    low = sliding(np.minimum, names, width)
    starts = starts[: len(low)]
    floor = np.where(starts, low, K.U64(0))
    padded = np.concatenate([np.zeros(width - 1, K.U64), floor, np.zeros(len(names) - len(low), K.U64)])
    best = sliding(np.maximum, padded, width)
    return np.flatnonzero((best == names[: len(best)]) & (best > 0)), floor
