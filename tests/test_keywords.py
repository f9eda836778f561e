"""Keyword tagging by an automaton, against substring tests one by one."""

import random
import time

import pyarrow as pa
import pytest

from barloom.operators.keywords import LANE, Automaton, Tagger


def plain(words, text):
    return None if text is None else sorted({t for k, t in words if k in text.lower()})


def made(seed, n=200, letters="abcé日"):
    rng = random.Random(seed)
    words = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))), f"t{rng.randint(0, 40)}") for _ in range(n)]
    texts = ["".join(rng.choice(letters + " XÉ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return words, texts


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    words, texts = made(seed, 3 ** (seed + 1))
    got = Automaton(words).tag(pa.array([t.lower() for t in texts])).to_pylist()
    assert got == [plain(words, t) for t in texts]


def test_keywords_across_lanes():
    words = [("needle" * 30, "long"), ("end", "short"), ("eedleneed", "part")]
    texts = ["x" * (LANE * 2 - k) + "needle" * 30 + "y" * LANE * 3 + "end" for k in range(0, 190, 7)] + ["", "needle" * 29]
    assert Automaton(words).tag(pa.array(texts)).to_pylist() == [plain(words, t) for t in texts]


def test_overlapping_and_nested_keywords():
    words = [("he", "a"), ("she", "b"), ("hers", "c"), ("his", "d"), ("h", "e"), ("er", "f"), ("", "always"), ("he", "a2")]
    assert Automaton(words).tag(pa.array(["ushers", "", "ahis", "zzz"])).to_pylist() == [plain(words, t) for t in ["ushers", "", "ahis", "zzz"]]
    assert Automaton([]).tag(pa.array(["a", ""])).to_pylist() == [[], []]


def test_tagger(spark):
    words, texts = made(9)
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "b" * 50_000 + "日É"), (0, "abc")]
    df = spark.createDataFrame(rows, "id long, text string")
    vocabulary = spark.createDataFrame([(k.upper(), t) for k, t in words] + [(None, "n"), ("x", None)], "keyword string, topic string")
    want = {i: plain(words, t) for i, t in rows[1:-1] if t and plain(words, t)} | {0: sorted({*plain(words, texts[0]), *plain(words, "abc")})}
    for part_bytes in (60_000, 200, 40):  # one automaton, several in a pass, several passes
        tagger = Tagger(spark, vocabulary, part_bytes)
        assert tagger.parts == -(-sum(len(k.lower().encode()) for k, _ in set(words)) // part_bytes)
        assert {r.id: r.topics for r in tagger.tagged(df, "id", "text").collect()} == want
    with pytest.raises(ValueError):
        tagger.topics(df.text)
    by_name = {}
    for k, t in words:
        by_name.setdefault(k, []).append(t)
    assert [r.t for r in df.select(Tagger(spark, by_name).topics(df.text).alias("t")).collect()] == [plain(words, t) or [] for _, t in rows]


def test_time_does_not_follow_the_number_of_keywords():
    words, _ = made(3, 4000, "abcdefghij")
    words = [(k + "q" * 4, t) for k, t in words]
    texts = pa.array(["".join(random.Random(i).choices("abcdefghij ", k=20_000)) for i in range(40)])
    few, many = Automaton(words[:20]), Automaton(words)
    took = []
    for automaton in (few, many):
        automaton.tag(texts)
        began = time.perf_counter()
        automaton.tag(texts)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]  # one test a keyword would be 200 times as many
