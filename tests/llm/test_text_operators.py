"""Exact deduplication, mixing, BPE, substrings and spans against brute force, with odd rows."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, debruijn, exact_dedup, mixing, prefix_doubling
from barloom.llm.queries import ranks_file

from .conftest import LONG, copies

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def sample(seed=1, n=60):
    """Texts with shared passages, copies, repeated lines, nulls, empty and blank ones, and a long one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(70) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 60) :], say(rng.randint(0, 30))]
        rows.append((i, "\n".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (n + 5, LONG), (n + 6, LONG), (n + 7, "ab " * 200), (n + 8, "é" * 300)]
    return rows


def test_exact_dedup(make):
    rows = sample()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.groups(make(rows)).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.survivors(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert kept.columns == make(rows).columns


def test_exact_dedup_odd_rows(make):
    got = exact_dedup.groups(make([(None, "a"), (5, "A"), (5, "a"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.groups(make([])).count() == 0


def test_exact_dedup_keeps_rows_by_id_and_text(make):
    rows = [(5, "aaa"), (9, "AAA"), (5, "bbb"), (None, "n"), (None, "n"), (None, "c"), (4, "c")]
    df = make(rows).withColumn("__id", F.lit(1)).withColumn("digest", F.lit(2))
    kept = exact_dedup.survivors(df)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(9, "AAA"), (5, "bbb"), (None, "n"), (None, "n"), (4, "c")], key=str)
    assert kept.columns == df.columns


def test_clashing_columns_pass_through(make):
    rows = [(i, f"text {i}", "a" if i % 2 else "b") for i in range(40)]
    df = make(rows).withColumns({c: F.lit(77) for c in ("__n", "__copy", "__source", "mix_source", "MIX_KEY", "Copy_No")})
    out = mixing.mix(df)
    assert [c.lower() for c in out.columns].count("copy_no") == 1
    assert {(r["__n"], r["__copy"], r["__source"], r["mix_source"], r["MIX_KEY"]) for r in out.collect()} == {(77,) * 5}
    coded = bpe.encode(df.withColumns({"N_Tokens": F.lit(1), "__text": F.lit("t")}), ranks_file())
    assert [c.lower() for c in coded.columns].count("n_tokens") == 1 and {r["__text"] for r in coded.collect()} == {"t"}


def test_another_pattern_is_refused(make):
    import public_tokenizers as P

    assert bpe.PATTERN == P.PATTERN
    with pytest.raises(ValueError):
        bpe.encode(make([]), ranks_file(), pattern=r"\S+")


def test_mix_counts(make):
    rows = [(i, f"text {i} " * (1 + i % 3), "big" if i % 10 else "small") for i in range(400)] + [(None, None, None), (7, "", "big")]
    out = mixing.mix(make(rows)).collect()
    want = copies(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.source, r.copy_no) for r in out), key=key) == sorted(want, key=key)
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make(rows), extra=False).columns == make(rows).columns


def test_mix_reaches_weights(make):
    rows = [(i, "same words", "a" if i % 4 else "b") for i in range(4000)]
    out = mixing.mix(make(rows), weights={"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.03 and abs(sum(n.values()) - 4000) < 300


@pytest.mark.parametrize("seed", range(2))
def test_bpe_is_tiktoken(make, seed):
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "a", "bc", "é", "1", "²", "!", "?", "中", " ", "\x1c", "l", "ve", "😀", "\r\n", "'t", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", LONG, "x" * 3000, "it's we'll 'tis"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = make(list(enumerate(texts)))
    got = bpe.encode(df, ranks_file())
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(got, ranks_file(), keep=["doc_id"]).collect()}
    for r in got.collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and back[r.doc_id] == t.encode()
    assert bpe.encode(make([]), ranks_file()).count() == 0


def test_perfect_hash_is_minimal():
    import numpy as np

    names = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = bpe.PerfectHash(names)
    assert sorted(h.probe(names).tolist()) == list(range(5000))


def test_repeated_substrings(make):
    rows = sample(2)
    seen = set()
    got = {r.doc_id: r for r in prefix_doubling.removed(make(rows)).collect()}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(b[k : k + 100])
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()), i
    assert prefix_doubling.removed(make([])).count() == 0


def test_repeated_substrings_odd_rows(make):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    got = prefix_doubling.removed(make([(None, t), (1, t), (1, t)]), kept_text=True).collect()
    assert sorted((r.doc_id or 9, r.n_removed, len(r.kept)) for r in got) == [(1, 0, len(t)), (1, 0, len(t)), (9, len(t), 0)]


def test_largest_doc_id_is_not_null(make):
    t = " ".join(f"word{i}" for i in range(80))
    top = 2**63 - 1
    rows = [(top, t), (5, "x"), (None, t), (None, None)]
    for found in (prefix_doubling.removed(make(rows)), debruijn.removed(make(rows))):
        got = sorted(((r.doc_id, r.n_removed > 0) for r in found.collect()), key=str)
        assert got[0] == (5, False) and got[1][0] == top and [g[0] for g in got[2:]] == [None, None]


def test_rows_of_one_name_with_other_checks_are_told_apart():
    n = np.array([7, 7, 7, 9, 9, 7], np.uint64)
    c = np.array([1, 2, 1, 3, 3, 2], np.uint64)
    place = np.array([5, 1, 2, 0, 4, 3])
    for first, which in (prefix_doubling.firsts((n, c), place), prefix_doubling.distinct(n, (c,), place)):
        assert [(int(n[i]), int(c[i]), int(place[i])) for i in first] == [(7, 1, 2), (7, 2, 1), (9, 3, 0)] and which.tolist() == [0, 1, 0, 2, 2, 1]
    ids, ones = np.arange(6), np.zeros(6, np.uint8)
    assert prefix_doubling.repeated(None, n, np.arange(6, dtype=np.uint64), ones).tolist() == [0] * 6
    assert prefix_doubling.started(None, n, c, ids, ids).tolist() == [False, False, True, False, True, True]
    w = debruijn.Windows(n, c, np.array([3, 4, 2, 6, 5, 1]))
    assert w.lo.tolist() == [2, 1, 5] and w.hi.tolist() == [3, 4, 6] and w.which.tolist() == [0, 1, 0, 2, 2, 1]


def test_an_edge_whose_words_differ_is_on_no_path(spark):
    rows = [(1, 11, 10, 5, 0, 2, 3), (1, 11, 20, 5, 0, 2, 3), (2, 12, 10, 6, 5, 0, 0), (2, 13, 20, 6, 5, 0, 0)]
    df = spark.createDataFrame(rows, "edge long, check long, doc long, link long, before long, after long, gap int")
    got = {r.edge: r for r in debruijn.repeated(df).collect()}
    assert (got[1].link, got[1].after) == (5, 2) and (got[2].link, got[2].before) == (None, None)
    paths = {r.edge: (r.path, r.place) for r in debruijn.compacted(debruijn.repeated(df)).collect()}
    assert paths == {1: (1, 0), 2: (2, 0)}
    same = spark.createDataFrame([(*r[:1], 12 if r[0] == 2 else 11, *r[2:]) for r in rows], df.schema)
    assert {r.edge: (r.path, r.place) for r in debruijn.compacted(debruijn.repeated(same)).collect()} == {1: (1, 0), 2: (1, 3)}


def test_checks_tell_spans_apart():
    import pyarrow as pa

    from barloom.llm import _kernels as K

    data, offsets = K.text_buffer(pa.array(["ab c ab  c", "abc ab\nc x", "a bc"]))
    starts, _, at = K.word_spans(data, offsets)
    words, own = K.Checks.of_words(data, starts), K.Checks.of_bytes(data)
    span = lambda d, a, b: int(words.between(at[d : d + 1] + a, at[d : d + 1] + b)[0])
    assert span(0, 0, 2) == span(0, 2, 4) == span(1, 1, 3) != span(1, 0, 2) and span(2, 0, 2) not in (span(0, 0, 2), span(1, 0, 1))
    raw = bytes(data)
    pairs = [(a, b) for a in range(len(raw)) for b in range(a + 1, len(raw) + 1)]
    names = own.between(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist()
    assert len(set(names)) == len({raw[a:b] for a, b in pairs}) == len({(raw[a:b], n) for (a, b), n in zip(pairs, names)})


def test_repeated_spans(make):
    rows = sample(3)
    seen, got = set(), {r.doc_id: r for r in debruijn.removed(make(rows)).collect()}
    for i, t in rows:
        w = SPACE.findall((t or "").encode())
        gone, own = [0] * len(w), set()
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            if x in seen:
                gone[k : k + 50] = [1] * 50
            own.add(x)
        seen |= own
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(rest).hexdigest()), i
    assert debruijn.removed(make([])).count() == 0


def test_repeated_spans_odd_rows(make):
    t = " ".join(f"w{i}" for i in range(80))
    got = debruijn.removed(make([(None, t), (1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 80), (9, 80)]
