"""Operator 13: conversation prefix trie.

Conversation c is rebuilt from its base, conversation c - c % FAMILY: the base's first
h original turns (all if fewer, none if it is absent), then c's own turns after its first h,
with h = crc32(decimal c) % HEADS.  Each distinct sequence of first turns of rebuilt
conversations is a node; the root has none.

1. Turns are numbered in order of turn (null first) and become narrow rows of a digest of role and text; texts
   are not shuffled.  Numbers come from blocks of turn numbers and the sizes of the blocks before.
2. Families (conversations of one base id) are cogrouped with the first turns of their base, in pieces of
   PIECE turns a conversation, so that no task holds a long conversation whole.  A task rebuilds the family's
   conversations, and its small trie has one row for each node: the members among at most 2 * FAMILY - 1
   conversations, and those that end there.
3. Only these rows are shuffled, to be merged by node.  The name of a node is its depth and 128 bits, the
   exclusive or of what its turns' digests give at their depths; so a piece starts from the names of the pieces before it.
4. Sums over subtrees take no rounds.  A node belongs to its smallest member c, whose nodes are the lower end of c's
   path, and is summed up along that path; a node's sum is that of its members' paths from its depth on.  Rows are
   as many as rebuilt turns.
5. Ends of a node are joined in sorted runs by range, and the runs are digested one after the other in a
   stream: SHA-256 cannot be split, but only runs of up to RUN_BYTES reach the task of a node.

Null role and text are empty.  A null conv_id is one conversation of its own, without a base, smaller than all
others, written as null and, among ends, as nothing.  Ties: turns of equal number are ordered by role, then by the
SHA-256 of role and text.  Repeated rows are turns of their own.  An empty table gives an empty result.  Very long texts
are digested where they are read.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import partitions, ship, staged

FAMILY, HEADS = 5, 9
#: At least HEADS - 1: turns that a base may replace are in the first piece.
PIECE = 1024
RUN_BYTES = 1 << 20
#: Stands for a null conv_id.
NONE = -(1 << 63)
NAME = ["depth", "n1", "n2"]
_SECOND = K.U64(0x7B1E5EED)

NODE_SCHEMA = "depth long, n1 long, n2 long, p1 long, p2 long, convs array<long>, bytes long, ends array<long>"
NODE_TYPE = pa.schema([("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("convs", pa.list_(pa.int64())), ("bytes", pa.int64()), ("ends", pa.list_(pa.int64()))])
STATE_SCHEMA = "base long, piece long, conv long, s1 long, s2 long"
STATE_TYPE = pa.schema([(c, pa.int64()) for c in ("base", "piece", "conv", "s1", "s2")])


def heads_of(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return 0 if conv == NONE else zlib.crc32(str(conv).encode()) % HEADS


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """base, conv, pos (from 1), total, digest, bytes: one narrow row a turn, written once."""
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    conv = F.col(f"`{conv_id}`").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(of(role)).cast("string"), F.lit(":"), of(role), of(text)), 256))
    rows = turns.select(
        F.coalesce(conv - conv % FAMILY, F.lit(NONE)).alias("base"), F.coalesce(conv, F.lit(NONE)).alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        of(role).alias("role"), digest.alias("digest"), F.octet_length(of(text)).cast("long").alias("bytes"),
    ).withColumn("block", F.floor(F.col("turn") / PIECE))
    key = ["base", "conv", "block"]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), "role", "digest")))
    blocks = rows.groupBy(*key).agg(F.max("place").alias("n"))
    every = Window.partitionBy("base", "conv")
    before = every.orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("__conv"), F.col("block").alias("__block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(every).alias("total"))
    same = (F.col("conv") == F.col("__conv")) & F.col("block").eqNullSafe(F.col("__block"))
    out = rows.join(blocks, same).select("base", "conv", (F.col("start") + F.col("place")).alias("pos"), "total", "digest", "bytes")
    return staged(out, "trie-turns")


def codes(digests: pa.Array, depth: np.ndarray) -> np.ndarray:
    """What each turn gives to the names of the nodes from its depth on: two numbers."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), K.U64).reshape(-1, 4)
    at = depth.astype(K.U64)
    return np.stack([K.pair(flat[:, 0] ^ K.mix(flat[:, 2] + K.MULT), at), K.pair(flat[:, 1] ^ K.mix(flat[:, 3] + _SECOND), at)])


def rebuilt(own: pa.Table, piece: int, heads: list[dict]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, int | None]]:
    """conversation, digests, bytes, depths, depth of its end (None: not in this piece) of each conversation's part in a piece.

    heads: the base's first turns in order.
    """
    own = own.sort_by([("conv", "ascending"), ("pos", "ascending")])
    conv, pos, total = (np.asarray(own.column(c).combine_chunks()) for c in ("conv", "pos", "total"))
    digests, sizes = own.column("digest").combine_chunks(), np.asarray(own.column("bytes").combine_chunks())
    names, first = np.unique(conv, return_index=True)
    for c, a, b in zip(names.tolist(), first, np.append(first[1:], len(conv))):
        h = heads_of(c)
        k = min(h, len(heads))
        tail = a + int(np.searchsorted(pos[a:b], h, "right"))
        depth = k + pos[tail:b] - h
        digest, size = digests.slice(tail, b - tail), sizes[tail:b]
        if piece == 0 and k:
            digest = pa.concat_arrays([pa.array([x["digest"] for x in heads[:k]], digest.type), digest])
            size, depth = np.concatenate([[x["bytes"] for x in heads[:k]], size]), np.concatenate([np.arange(1, k + 1), depth])
        yield c, digest, size, depth, k + max(int(total[a]) - h, 0) if pos[b - 1] == total[a] else None


def piece_nodes(own: pa.Table, piece: int, heads: list[dict], states: dict[int, tuple[int, int]]) -> pa.Table:
    """The small trie of a family's piece: one row a node, with its members and the members that end there."""
    parts = []
    for c, digest, size, depth, end in rebuilt(own, piece, heads):
        start = np.array([[x] for x in states.get(c, (0, 0))], np.int64).view(K.U64)
        name = np.bitwise_xor.accumulate(np.concatenate([start, codes(digest, depth)], axis=1), axis=1)
        above = name[:, :-1]
        if piece == 0:
            name, above = np.concatenate([start, name[:, 1:]], axis=1), np.concatenate([start, above], axis=1)
            depth, size = np.append(0, depth), np.append(0, size)
        else:
            name = name[:, 1:]
        parts.append((np.full(len(depth), c), depth, name[0], name[1], above[0], above[1], size, depth == (-1 if end is None else end)))
    if not parts:
        return NODE_TYPE.empty_table()
    conv, depth, n1, n2, p1, p2, size, ends = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((conv, n2, n1, depth))
    conv, depth, n1, n2, p1, p2, size, ends = (x[order] for x in (conv, depth, n1, n2, p1, p2, size, ends))
    new = np.append(True, (depth[1:] != depth[:-1]) | (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1]))[: len(depth)]
    first = np.flatnonzero(new)
    ending = np.append(0, np.cumsum(ends))
    bounds = np.append(first, len(depth))
    lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
    signed = lambda x: pa.array(x[first].view(np.int64))
    return pa.Table.from_arrays([signed(depth.astype(np.int64)), signed(n1), signed(n2), signed(p1), signed(p2), lists(conv, bounds), signed(size.astype(np.int64)), lists(conv[ends], ending[bounds])], schema=NODE_TYPE)


def family_nodes(turns: DataFrame) -> DataFrame:
    """Rows of NODE_SCHEMA, of numbered() turns: the nodes of each family's piece; written once."""
    own = turns.withColumn("piece", F.floor((F.col("pos") - 1) / PIECE))
    heads = turns.where((F.col("conv") == F.col("base")) & (F.col("conv") != NONE) & (F.col("pos") < HEADS))
    heads = heads.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("heads"))
    pieces = own.groupBy("base", "piece").agg(F.max("total").alias("longest")).join(heads, "base", "left")
    pieces = pieces.select(F.col("base").alias("b"), F.col("piece").alias("p"), "longest", "heads")

    # what earlier pieces give to the names of a conversation's nodes; only long conversations have such pieces
    def sums(own: pa.Table, beside: pa.Table) -> pa.Table:
        rows = []
        for r in beside.to_pylist() if len(own) else []:
            for c, digest, _, depth, _ in rebuilt(own, r["p"], r["heads"] or []):
                rows.append((r["b"], r["p"], c, *np.bitwise_xor.reduce(codes(digest, depth), axis=1).view(np.int64).tolist()))
        return pa.Table.from_pylist([dict(zip(STATE_TYPE.names, r)) for r in rows], schema=STATE_TYPE)

    long = own.where(F.col("total") > PIECE)
    states = long.groupBy("base", "piece").cogroup(pieces.where(F.col("longest") > PIECE).groupBy("b", "p")).applyInArrow(sums, STATE_SCHEMA)
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    states = states.select(F.col("base").alias("b"), F.col("piece").alias("p"), F.struct("conv", F.bit_xor("s1").over(before).alias("s1"), F.bit_xor("s2").over(before).alias("s2")).alias("state")).where("state.s1 IS NOT NULL")
    beside = pieces.join(states.groupBy("b", "p").agg(F.collect_list("state").alias("states")), ["b", "p"], "left")

    def nodes(own: pa.Table, beside: pa.Table) -> pa.Table:
        r = beside.to_pylist()[0]
        return piece_nodes(own, r["p"], r["heads"] or [], {s["conv"]: (s["s1"], s["s2"]) for s in r["states"] or []})

    return staged(own.groupBy("base", "piece").cogroup(beside.groupBy("b", "p")).applyInArrow(nodes, NODE_SCHEMA), "trie-families")


def subtree_sums(families: DataFrame, nodes: DataFrame) -> DataFrame:
    """NAME, n_leaves, saved of each node.  nodes: NAME, conv_id, weight, leaf (1 if childless)."""
    none = F.lit(None).cast("long")
    paths = families.select(F.explode("convs").alias("conv"), *NAME, F.lit(0).cast("long").alias("weight"), F.lit(0).alias("leaf"))
    owned = nodes.select(F.col("conv_id").alias("conv"), "depth", none.alias("n1"), none.alias("n2"), "weight", "leaf")
    piece = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / PIECE)
    rows = paths.union(owned).withColumn("piece", piece)
    # within a piece from its end up to here, own nodes before the path's row of the same depth
    below = Window.partitionBy("conv", "piece").orderBy(F.desc("depth"), F.col("n1").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv", "piece", *NAME, F.sum("weight").over(below).alias("weight"), F.sum("leaf").over(below).alias("leaf")).where("n1 IS NOT NULL")
    # what lies in later pieces; a conversation has one for each PIECE of its turns, and only then more than one
    each = paths.select("conv", "depth", "weight", "leaf").union(owned.select("conv", "depth", "weight", "leaf")).withColumn("piece", piece)
    each = each.groupBy("conv", "piece").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("conv", "piece", F.sum("weight").over(later).alias("more"), F.sum("leaf").over(later).alias("leaves")).where("more IS NOT NULL")
    rows = rows.join(each, ["conv", "piece"], "left")
    return rows.groupBy(*NAME).agg(F.sum(F.col("weight") + F.coalesce("more", F.lit(0))).alias("saved"), F.sum(F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"))


def ends_digests(families: DataFrame) -> DataFrame:
    """NAME, ends_sha256 of each node where a conversation ends: of the decimal ids in order, joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        first, held, size = 0, [], 0
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((*now, first, ",".join(held)))

        def emitted() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=[*NAME, "first", "run"])
            out.clear()
            return got

        for batch in batches:
            for *name, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(name) != now or size > RUN_BYTES:
                    close()
                    now, first, held, size = tuple(name), conv, [], 0
                held.append("" if conv == NONE else str(conv))
                size += len(held[-1]) + 1
            if out:
                yield emitted()
        close()
        if out:
            yield emitted()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state = hashlib.sha256()
        out: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names=[*NAME, "ends_sha256"])
            out.clear()
            return got

        for batch in batches:
            for *name, _, run in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(name) == now:
                    state.update(b",")
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = tuple(name), hashlib.sha256()
                state.update(run.encode())
            if out:
                yield emitted()
        if now:
            out.append((*now, state.hexdigest()))
            yield emitted()

    n = partitions(families.sparkSession)
    ends = families.select(*NAME, F.explode("ends").alias("conv")).repartitionByRange(n, *NAME, "conv").sortWithinPartitions(*NAME, "conv")
    ends = ends.mapInArrow(runs, "depth long, n1 long, n2 long, first long, run string")
    return ends.repartition(n, *NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digested, "depth long, n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(turns.sparkSession)
    families = family_nodes(numbered(turns, conv_id, turn, role, text))
    merged = families.groupBy(*NAME).agg(F.min(F.col("convs")[0]).alias("conv_id"), F.sum(F.size("convs")).alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes"))
    merged = staged(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(merged.join(children, NAME, "left").fillna(0, ["n_children"]), "trie-nodes")
    weight = ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight")
    sums = subtree_sums(families, nodes.select(*NAME, "conv_id", weight, (F.col("n_children") == 0).cast("int").alias("leaf")))
    out = nodes.join(sums, NAME).join(ends_digests(families), NAME, "left")
    above = nodes.select((F.col("depth") + 1).alias("__depth"), F.col("n1").alias("__n1"), F.col("n2").alias("__n2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above, (F.col("depth") == F.col("__depth")) & (F.col("p1") == F.col("__n1")) & (F.col("p2") == F.col("__n2")), "left")
    shown = lambda c: F.nullif(F.col(c), F.lit(NONE).cast("long")).alias(c)
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return out.select(shown("conv_id"), "depth", shown("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)
