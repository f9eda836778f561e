"""Operator 2: language-model scoring with a log-frequency Bloom filter.

A bigram model is learned from the training documents.  Counts are quantised to
powers of BASE; a key whose quantised count is q is entered q times, as
(key, 1) ... (key, q), so its count is found again by probing (key, 1), (key, 2)
... until one is missing.  An entry is a pattern of PROBES bits in one 64-bit word.  The filter holds every bigram, and for each context the
mass S of its bigrams and the back-off mass B (the number of distinct successors, as
in Witten-Bell smoothing):

    p(w | h) = (c(h w) + B(h) p1(w)) / (S(h) + B(h)),   p1(w) = (c(w) + 1) / (N + V + 1)

Keys of one context share a segment of the filter, so every reducer builds its
own segment; segments are packed into shards of at most SHARD_BYTES, and each
shard is broadcast for one pass over the texts, whose result is written before the
next shard is fetched, so one shard at a time is in memory.  The unigram filter is broadcast
with each; beyond UNIGRAM_BYTES it is split likewise, and passes of its own write the
level of every token beside the texts.  The counts of contexts among the HOT most frequent words are split over
all reducers, as one word may precede a third of all tokens.

base_score uses exact counts: the FREQUENT most frequent words are broadcast, all
others are looked up by a join.

Tokens: words of the text with A-Z lower-cased, named by 64-bit hashes, then one
end.  Null and empty texts have the end alone.  Rows with a null doc_id are held out.
Repeated rows count, and are scored, each.  Without training documents N and V are 0.
An empty table gives an empty result.  A very long text is tokenised whole, as a batch
of its own.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import dropped, partitions, ship, staged

BASE, BITS, PROBES = 1.5, 12, 4
SHARD_BYTES, UNIGRAM_BYTES, FETCH_BYTES = 64 << 20, 256 << 20, 12 << 20
HOT, FREQUENT = 256, 1 << 18
HELD_OUT_OF, HELD_OUT = 7, 2
END = K.U64(0xE0D0E0D0E0D0E0D1)
FLUSH = 3_000_000
LOW40 = K.U64((1 << 40) - 1)

_EDGES = BASE ** np.arange(0, 110)
#: Mean of the whole numbers of each quantised step.
VALUES = np.array([0.0] + [(np.ceil(a - 1e-9) + max(np.ceil(a - 1e-9), np.ceil(b - 1e-9) - 1)) / 2 for a, b in zip(_EDGES[:-1], _EDGES[1:])])


def _patterns() -> np.ndarray:
    """Words with PROBES different bits set, by a fixed rule."""
    draws = np.argsort(K.mix(np.arange((1 << 14) * 64, dtype=K.U64) ^ K.U64(0xB10F)).reshape(-1, 64), axis=1)[:, :PROBES]
    return np.bitwise_or.reduce(K.U64(1) << draws.astype(K.U64), axis=1)


PATTERNS = _patterns()


def quantised(c: np.ndarray) -> np.ndarray:
    """0 for counts under 1, else 1 + floor(log(c) to BASE)."""
    return np.searchsorted(_EDGES, np.asarray(c, float) + 1e-9, "right")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(True))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token names (each document closed by END) and their offsets by document."""
    names, at = K.words_of(data, offsets, True)
    n = len(offsets) - 1
    out_at = at + np.arange(n + 1)
    out = np.full(len(names) + n, END, K.U64)
    place = np.ones(len(out), bool)
    place[out_at[1:] - 1] = False
    out[place] = names
    return out, out_at


def contexts(toks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each token; END before the first of a document."""
    h = np.empty_like(toks)
    h[1:] = toks[:-1]
    if len(h):
        h[at[:-1]] = END
    return h


def entries(keys: np.ndarray, levels: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each entry (key, level) in its segment of so many words, and its bits there."""
    h = K.pair(keys, np.asarray(levels, K.U64))
    return ((h >> K.U64(32)) * np.asarray(words, K.U64) >> K.U64(32)).astype(np.int64), PATTERNS[h & K.U64(len(PATTERNS) - 1)]


def segment(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Words of bits with each key entered once for each of its levels."""
    words = max(1, -(-int(levels.sum()) * BITS // 64))
    at, bits = entries(np.repeat(keys, levels), K.ranges(np.ones(len(keys), np.int64), levels), words)
    out = np.zeros(words, K.U64)
    order = np.argsort(at)
    at, first = np.unique(at[order], return_index=True)
    if len(at):
        out[at] = np.bitwise_or.reduceat(bits[order], first)
    return out


class Filter:
    """Segments side by side; probes count up until a level is missing."""

    def __init__(self, buckets: int, sizes: list[tuple[int, int]]):
        """sizes: (bucket, bytes); put() fills them."""
        self.words = np.zeros(buckets, np.int64)
        for bucket, length in sizes:
            self.words[bucket] = length // 8
        self.starts = np.concatenate([[0], np.cumsum(self.words)[:-1]])
        self.bits = np.zeros(int(self.words.sum()), K.U64)

    def put(self, bucket: int, blob: bytes) -> None:
        self.bits[self.starts[bucket] : self.starts[bucket] + self.words[bucket]] = np.frombuffer(blob, K.U64)

    def count(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Levels found for each key."""
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.words[bucket])
        keys, words, starts = keys[live], self.words[bucket[live]].astype(K.U64), self.starts[bucket[live]]
        level = 0
        while len(live):
            level += 1
            at, bits = entries(keys, level, words)
            found = self.bits[starts + at] & bits == bits
            live, keys, words, starts = live[found], keys[found], words[found], starts[found]
            out[live] = level
        return out


def kept_key(h: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.U64(0x5151))


def backoff_key(h: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.U64(0xB0B0))


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(names ^ K.U64(0x77)) % K.U64(buckets)).astype(np.int64)


def pair_bucket(h: np.ndarray, code: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each bigram (that of its context, or of itself if the context is hot), and whether it is hot."""
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
    return bucket_of(np.where(is_hot, code, h), buckets), is_hot


def code_of(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.pair(h, w) & LOW40


def packed_pairs(h: np.ndarray, code: np.ndarray, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counted bigrams, one row per bucket: contexts, run lengths, 40-bit codes and counts."""
    bucket, is_hot = pair_bucket(h, code, hot, buckets)
    group = np.where(is_hot, K.pair(h, bucket.astype(K.U64)), h)
    _, first, inv = np.unique(group, return_index=True, return_inverse=True)
    order = np.argsort(bucket[first], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = np.sort(rank[inv].astype(K.U64) << K.U64(40) | code)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key))).astype(np.uint32)
    key = key[new]
    g = (key >> K.U64(40)).astype(np.int64)
    runs = np.bincount(g, minlength=len(order)).astype(np.uint32)
    ctx, ctx_bucket = h[first][order], bucket[first][order]
    codes = np.ascontiguousarray((key & LOW40).view(np.uint8).reshape(-1, 8)[:, :5])
    present = np.unique(ctx_bucket)
    g_lo, g_hi = np.searchsorted(ctx_bucket, present), np.searchsorted(ctx_bucket, present, "right")
    p_lo, p_hi = np.searchsorted(g, g_lo), np.searchsorted(g, g_hi)
    blobs = [[x[a:b].tobytes() for a, b in zip(lo, hi)] for x, lo, hi in ((ctx, g_lo, g_hi), (runs, g_lo, g_hi), (codes, p_lo, p_hi), (count, p_lo, p_hi))]
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], names=["bucket", "ctx", "runs", "codes", "counts"])


def merged(rows: list[tuple[bytes, bytes, bytes, bytes]], hot: np.ndarray) -> tuple[bytes, bytes]:
    """The segment of one bucket, and its part of the hot contexts' masses."""
    ctx = np.concatenate([np.frombuffer(r[0], K.U64) for r in rows])
    runs = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows]).astype(np.int64)
    raw = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]).reshape(-1, 5)
    code = np.zeros((len(raw), 8), np.uint8)
    code[:, :5] = raw
    count = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]).astype(np.int64)
    h, inv = np.unique(ctx, return_inverse=True)
    key = np.repeat(inv, runs).astype(K.U64) << K.U64(40) | code.view(K.U64).ravel()
    order = np.argsort(key)
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, count = key[new], np.add.reduceat(count, new)
    g = (key >> K.U64(40)).astype(np.int64)
    level = quantised(count)
    s = np.bincount(g, VALUES[level], minlength=len(h))
    b = np.bincount(g, minlength=len(h))
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
    mass = np.column_stack([at[is_hot].astype(float), s[is_hot], b[is_hot]])
    own = h[~is_hot]
    keys = np.concatenate([K.pair(h[g], key & LOW40), kept_key(own), backoff_key(own)])
    levels = np.concatenate([level, quantised(s[~is_hot]), quantised(b[~is_hot])])
    return segment(keys, levels).tobytes(), mass.tobytes()


def count_words(docs: DataFrame) -> DataFrame:
    """name, c: tokens of the training documents, counted by partition before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = np.concatenate([x for x, _ in held])
            u, inv = np.unique(name, return_inverse=True)
            c = np.bincount(inv, np.concatenate([y for _, y in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["name", "c"])

        for batch in batches:
            data, offsets = K.text_buffer(batch.column(0))
            for a, b in K.chunks(offsets):
                toks, _ = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append(np.unique(toks, return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(work, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame) -> dict:
    """The model: exact word counts (a table), both filters and the hot contexts.  docs: doc_id, held_out, text."""
    spark = docs.sparkSession
    words = staged(count_words(docs), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    names, counts = packed_words(words.orderBy(F.desc("c"), "name").limit(FREQUENT))
    order = np.argsort(names)
    hot, buckets = np.sort(names[:HOT]), 4 * max(partitions(spark), int(n // 20_000_000))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, size = [], [], 0
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(0))
            for a, b in K.chunks(offsets):
                toks, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = contexts(toks, at)
                hs.append(h)
                cs.append(code_of(h, toks))
                size += len(h)
                if size >= FLUSH:
                    yield packed_pairs(np.concatenate(hs), np.concatenate(cs), hot, buckets)
                    hs, cs, size = [], [], 0
        if size:
            yield packed_pairs(np.concatenate(hs), np.concatenate(cs), hot, buckets)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("ctx", "runs", "codes", "counts"))))
        bits, mass = merged(rows, hot)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary()), "mass": pa.array([mass], pa.binary())})

    def build_words(key: tuple, table: pa.Table) -> pa.Table:
        name = np.asarray(table.column("name")).view(K.U64)
        bits = segment(name, quantised(np.asarray(table.column("c")))).tobytes()
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(pairs, "bucket int, ctx binary, runs binary, codes binary, counts binary")
    segments = staged(counted.groupBy("bucket").applyInArrow(build, "bucket int, bits binary, mass binary"), "lm-segments")

    def word_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = bucket_of(np.asarray(batch.column(0)).view(K.U64), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bucket)], names=["name", "c", "bucket"])

    by_word = words.mapInArrow(word_buckets, "name long, c long, bucket int")
    word_segments = staged(by_word.groupBy("bucket").applyInArrow(build_words, "bucket int, bits binary"), "lm-word-segments")
    word_sizes, sizes = (sorted(tuple(r) for r in x.select("bucket", F.octet_length("bits")).collect()) for x in (word_segments, segments))

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(hot), 2))
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                part = np.frombuffer(blob).reshape(-1, 3)
                np.add.at(total, part[:, 0].astype(np.int64), part[:, 1:])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["at", "s", "b"])

    # one row for each hot context reaches the driver; the masses are halves of whole numbers, so their order does not matter
    mass = np.zeros((len(hot), 2))
    for at, kept, back in segments.select("mass").mapInArrow(masses, "at long, s double, b double").groupBy("at").agg(F.sum("s"), F.sum("b")).collect():
        mass[at] = kept, back
    return {"n": int(n), "v": int(v), "words": words, "segments": segments, "word_segments": word_segments, "word_shards": packed(word_sizes, UNIGRAM_BYTES), "shards": packed(sizes, SHARD_BYTES), "hot": hot, "mass": mass, "buckets": buckets, "frequent": (names[order], counts[order])}


def packed(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Runs of (bucket, bytes) of at most so many bytes, or of one bucket."""
    out, size = [[]], 0
    for bucket, length in sizes:
        if out[-1] and size + length > most:
            out.append([])
            size = 0
        out[-1].append((bucket, length))
        size += length
    return out


def packed_words(top: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts of a bounded table of words, in its order; they reach the driver as two blobs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(i)).tobytes()], pa.binary()) for i in range(2)], names=["name", "c"])

    rows = top.select("name", "c").mapInArrow(work, "name binary, c binary").collect()
    return np.concatenate([np.frombuffer(r["name"], K.U64) for r in rows] + [np.zeros(0, K.U64)]), np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows] + [np.zeros(0, np.int64)])


def collected(df: DataFrame, sizes: list[tuple[int, int]], buckets: int) -> Filter:
    """The segments of these buckets (bucket, bytes), fetched some MB at a time."""
    out, part, size = Filter(buckets, sizes), [], 0
    for i, (bucket, length) in enumerate(sizes):
        part.append(bucket)
        size += length
        if size >= FETCH_BYTES or i == len(sizes) - 1:
            for r in df.where(F.col("bucket").isin(part)).select("bucket", "bits").collect():
                out.put(r["bucket"], r["bits"])
            part, size = [], 0
    return out


def levelled(rows: DataFrame, model: dict) -> DataFrame:
    """rows with the unigram level of each token as a byte, found shard by shard; each pass adds its own words' levels."""
    spark, buckets = rows.sparkSession, model["buckets"]
    rows = rows.withColumn("levels", F.lit(None).cast("binary"))
    for shard in model["word_shards"]:
        shared = spark.sparkContext.broadcast(collected(model["word_segments"], shard, buckets))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            unigrams = shared.value
            for batch in batches:
                data, offsets = K.text_buffer(batch.column(3))
                for a, b in K.chunks(offsets):
                    toks, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    word, inv = np.unique(toks, return_inverse=True)
                    level = unigrams.count(word, bucket_of(word, buckets)).astype(np.uint8)[inv]
                    part = batch.slice(a, b - a)
                    if not part.column(4).null_count:
                        level += np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
                    blobs = pa.array([level[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], blobs], names=part.schema.names)

        done = staged(rows.mapInArrow(work, rows.schema), "lm-levels")
        dropped(spark, rows)
        shared.destroy()
        rows = done
    return rows


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    n, v, buckets, hot, mass = model["n"], model["v"], model["buckets"], model["hot"], model["mass"]
    names, counts = model["frequent"]
    floor = float(n + v + 1)
    several = len(model["word_shards"]) > 1
    unigrams = None if several else collected(model["word_segments"], model["word_shards"][0], buckets)
    # all passes of a document share the id of its row, so it is written down where there are several
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    if several:
        rows = levelled(rows, model)
    elif len(model["shards"]) > 1:
        rows = staged(rows, "lm-documents")
    passes = []
    for k, shard in enumerate(model["shards"]):
        shard_filter = collected(model["segments"], shard, buckets)
        shared = spark.sparkContext.broadcast((names, counts, unigrams, shard_filter))
        mine = np.zeros(buckets, bool)
        mine[[bucket for bucket, _ in shard]] = True

        def work(batches: Iterator[pa.RecordBatch], k=k, shared=shared, mine=mine) -> Iterator[pa.RecordBatch]:
            names, counts, unigrams, grams = shared.value
            for batch in batches:
                rid = np.asarray(batch.column(0))
                data, offsets = K.text_buffer(batch.column(3))
                for a, b in K.chunks(offsets):
                    toks, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    m = b - a
                    doc = np.repeat(np.arange(m), np.diff(at))
                    word, inv = np.unique(toks, return_inverse=True)
                    # the model's probability
                    h = contexts(toks, at)
                    code = code_of(h, toks)
                    bucket, is_hot = pair_bucket(h, code, hot, buckets)
                    here = mine[bucket] if len(mine) else np.zeros(0, bool)
                    level = grams.count(K.pair(h[here], code[here]), bucket[here])
                    c = VALUES[level]
                    if several:
                        p1 = (VALUES[np.frombuffer(b"".join(batch.column(4).slice(a, m).to_pylist()), np.uint8)[here]] + 1) / floor
                    else:
                        p1 = ((VALUES[unigrams.count(word, bucket_of(word, buckets))] + 1) / floor)[inv[here]]
                    ctx, c_inv = np.unique(h[here], return_inverse=True)
                    spot = np.minimum(np.searchsorted(hot, ctx), max(len(hot) - 1, 0))
                    ctx_hot = hot[spot] == ctx if len(hot) else np.zeros(len(ctx), bool)
                    cb = bucket_of(ctx, buckets)
                    s = VALUES[grams.count(kept_key(ctx), cb)]
                    back = VALUES[grams.count(backoff_key(ctx), cb)]
                    s[ctx_hot], back[ctx_hot] = mass[spot[ctx_hot], 0], mass[spot[ctx_hot], 1]
                    back = np.maximum(back, 1.0)  # a context that was seen has a successor; others back off whole
                    p = (np.minimum(c, s[c_inv] if len(s) else c) + back[c_inv] * p1) / (s + back)[c_inv]
                    score = np.bincount(doc[here], np.log10(np.minimum(p, 1.0)), minlength=m)
                    ids = rid[a:b]
                    if k:
                        yield rows_of(ids, batch, a, m, score=score)
                        continue
                    # exact counts of frequent words here, the others by a join
                    spot = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
                    known = names[spot] == word if len(names) else np.zeros(len(word), bool)
                    logs = np.where(known, np.log10(((counts[spot] if len(names) else 0) + 1) / floor), 0.0)
                    yield rows_of(ids, batch, a, m, score=score, base=np.bincount(doc, logs[inv], minlength=m), known=np.bincount(doc, known[inv], minlength=m).astype(np.int64), tokens=np.diff(at))
                    rare = ~known[inv]
                    key = np.sort(doc[rare].astype(np.int64) * len(word) + inv[rare])
                    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    tf = np.diff(np.append(new, len(key)))
                    yield rows_of(ids[key[new] // len(word)], None, 0, len(new), name=word[key[new] % len(word)].view(np.int64), tf=tf)

        found = rows.mapInArrow(work, ROWS)
        if len(model["shards"]) > 1:
            found = staged(found.select("rid", "score") if k else found, "lm-pass")
            shared.destroy()
        passes.append(found)
    found = passes[0].join(model["words"].withColumnRenamed("name", "__name"), F.col("name") == F.col("__name"), "left")
    rare_log = F.col("tf") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 1) / F.lit(floor))
    out = found.select("rid", "doc_id", "held_out", "tokens", (F.col("known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"), (F.col("base") + F.coalesce(rare_log, F.lit(0.0))).alias("base"), "score")
    for more in passes[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.drop("rid")


ROWS = "rid long, doc_id long, held_out boolean, tokens long, known long, base double, score double, name long, tf long"


def rows_of(ids: np.ndarray, batch: pa.RecordBatch | None, a: int, m: int, **given: np.ndarray) -> pa.RecordBatch:
    zero = {"tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
    cols = [pa.array(ids), batch.column(1).slice(a, m) if batch else pa.nulls(m, pa.int64()), batch.column(2).slice(a, m) if batch else pa.nulls(m, pa.bool_())]
    cols += [pa.array(np.asarray(given.get(c, np.zeros(m)))).cast(t) for c, t in zero.items()]
    cols += [pa.array(given[c]).cast(pa.int64()) if c in given else pa.nulls(m, pa.int64()) for c in ("name", "tf")]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ROWS.split(", ")])


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Learn from the training rows of ``docs`` and score all of them."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return scored(rows, fit(rows))
