"""Conversation prefix trie against brute force: families, long conversations in pieces, ties, nulls, hot nodes."""

import hashlib
import random
import zlib

import pytest

from barloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int, n1 string, base int, `a b` string"


def frame(spark, rows):
    """Rows (conv_id, turn, role, text) with further columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "c", 1, "n", 2, "z") for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        own.setdefault(c, []).append((turn is not None, turn or 0, role.encode(), digest, (role, text)))
    own = {c: [x[4] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple((own.get(base, [])[:h] if c is not None else []) + turns[h:])
    small = lambda c: (c is not None, c or 0)
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    below = {}
    for p in nodes:
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    first = {p: min(v, key=small) for p, v in nodes.items()}
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in nodes}
    return sorted(
        (
            str(first[p]), len(p), str(first[p[:-1]]) if p else "None", len(v), children[p], sum(not children[q] for q in below[p]),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q),
            hashlib.sha256(",".join("" if c is None else str(c) for c in sorted((c for c in v if len(full[c]) == len(p)), key=small)).encode()).hexdigest(),
        )
        for p, v in nodes.items()
    )


def found(df):
    assert dict(df.dtypes) == dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint") | {"ends_sha256": "string"}
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((str(r[0]), r[1], str(r[2]), *r[3:]) for r in df.select(*names).collect())


def corpus(seed=4, n=120):
    rng = random.Random(seed)
    say = lambda: rng.choice(["", "é", "hello", "x" * 30, "日本", None])
    rows = []
    for c in range(n):
        if c % 17 == 5 or c in (20, 40):
            continue  # families without a base, bases without a family
        start = [("user", "hello"), ("assistant", "x" * 30)][: rng.randint(0, 2)]
        turns = start + [(rng.choice(["user", "assistant", None]), say()) for _ in range(rng.choice([0, 1, 2, 6, 12, 25]))]
        rows += [(c, i * rng.choice([1, 1, 3]), *t) for i, t in enumerate(turns)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 300, 5) for t in range(12)]  # equal conversations that end at one node
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 0, None, "z"), (400, 0, "a", "z"), (400, 7, "u", None), (400, 7, "u", None)]
    rows += [(None, 1, "user", "hello"), (None, 0, "user", "x" * 30), (-3, 0, "user", "m"), (-7, 0, "user", "n"), (-5, 0, "user", "o"), (-5, 1, "user", "p"), (-10, 3, "user", "q")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece,run", [(1024, 1 << 20), (8, 5)])
def test_trie(spark, monkeypatch, piece, run):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "RUN_BYTES", run)
    rows = corpus()
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_long_conversations(spark, monkeypatch):
    """Conversations of one family that share a long beginning, over several pieces."""
    monkeypatch.setattr(trie, "PIECE", 50)
    rows = [(c, t, "user", f"{t}" if t < 40 * c else f"{c} {t}") for c in range(1, 5) for t in range(230 - c)] + [(7, t, "user", "again") for t in range(120)]
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert found(trie.trie(frame(spark, []))) == []
    # a conversation whose turns all come from an absent base is turnless, and ends at the root
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert found(trie.trie(frame(spark, rows))) == brute(rows) == [(str(lone), 0, "None", 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    rows = [(0, 0, "user", "w" * 3_000_000), (1, 0, "user", "w" * 3_000_000)]
    assert found(trie.trie(frame(spark, rows))) == brute(rows)
