"""Source divergence against brute force: odd rows, few counters, terms dealt over blocks; the sketch never discards a kept term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, source string, text string, value long, p string, term int, item string"


def frame(spark, rows):
    """Rows (lang, source, text) with further columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n, groups = Counter(), defaultdict(Counter), {(a, b) for a, b, _ in rows}
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOW))
        docs.update((lang, t) for t in set(found))
        n[lang, source].update(found)
        n[lang].update(found)
    out = set()
    for lang in {a for a, _ in groups}:
        kept = sorted(t for (a, t), k in docs.items() if a == lang and k >= least)
        own = sorted(b for a, b in groups if a == lang)
        p = {g: {t: 1 + 10**9 * (n[g][t] + 5) // (sum(n[g][x] for x in kept) + 5 * len(kept)) for t in kept} for g in [lang, *((lang, b) for b in own)]}
        for b in own:
            far = sorted((-sum(abs(p[lang, b][t] - p[lang, x][t]) for t in kept), x.encode(), x) for x in own if x != b)
            out |= {(lang, b, "pair", x, -v, i + 1) for i, (v, _, x) in enumerate(far)}
            more = sorted((p[lang][t] - p[lang, b][t], t.encode(), t) for t in kept if n[lang, b][t] and p[lang, b][t] > p[lang][t])
            out |= {(lang, b, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:top])}
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉéßz日") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = [(rng.choice(["en", "de"]), f"s{min(rng.randint(0, 9), 6)}", " ".join(rng.choice(words[: rng.randint(5, 120)]) + rng.choice(["", ",", "1x", "_Ab", "'s"]) for _ in range(rng.randint(0, 60)))) for _ in range(260)]
    rows += [rows[0]] * 5  # repeated rows count each
    rows += [(None, None, "Aa aa"), (None, "s1", None), ("", "s2", "AA"), ("fr", "s1", None), ("fr", "s2", ""), ("xx", "é", "a"), ("en", "none", "12 ; 3"), ("en", None, "É é Z"), ("de", "long", "ab " * 60_000)]
    return rows


def got(df):
    assert [t for _, t in df.dtypes] == ["string"] * 4 + ["bigint", "int"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least,top", [(3, 50), (12, 4)])
def test_audit(spark, least, top):
    rows = corpus()
    assert got(divergence.audit(frame(spark, rows), least=least, top=top)) == brute(rows, least, top)


def test_blocks_of_sources_and_a_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 2)
    rows = corpus(5)
    assert got(divergence.audit(frame(spark, rows), least=4, cells=64)) == brute(rows, 4, 50)


def test_nothing_kept_and_nothing_there(spark):
    rows = corpus()
    out = got(divergence.audit(frame(spark, rows), least=10_000))
    assert out == brute(rows, 10_000, 50) and {r[4] for r in out} == {0}
    assert got(divergence.audit(frame(spark, []))) == set()


def test_sketch_never_underestimates(spark, monkeypatch):
    rows = [(a or "", b or "", c or "") for a, b, c in corpus()]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    docs = Counter()
    for lang, _, text in rows:
        docs.update((lang, t) for t in set(TERM.findall(text.translate(LOW))))
    for cells, held in ((64, 1 << 20), (1 << 16, 50)):
        monkeypatch.setattr(divergence, "HELD", held)
        bits = divergence.reached(divergence.summed(divergence.sketched(df, cells), cells), cells, 9)
        found = divergence.counted(df, bits).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).collect()
        assert {(r.lang, r.term): r.docs for r in found if r.docs >= 9} == {k: v for k, v in docs.items() if v >= 9}
        if cells > 64:
            assert len(found) < len(docs) and sum(r.docs < 9 for r in found) < 5  # terms were discarded before the shuffle


def test_counters_stop_at_255(spark):
    df = spark.createDataFrame([("en", "s", "word")] * 700, "lang string, source string, text string").repartition(6)
    bits = divergence.reached(divergence.summed(divergence.sketched(df, 64), 64), 64, 255)
    assert np.unpackbits(bits, axis=1).sum(1).tolist() == [1] * divergence.DEPTH
