"""Weak supervision of quality rules: counts and base rules by brute force, the estimate document by document, odd rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import _kernels as K
from barloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c a b c", "é é é é é é", "x\ny\nx\n \nx\r\nx", "A!? #b\x0bC\x1cd", "日本 語 日本 語 日本", "a\n" * 30, "the " * 120]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = [i for i, x in enumerate(three) if three.count(x) > 1]
    lines = [x for x in t.split("\n") if WORD.search(x)]
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + o for i in twice for o in range(3)}),
        "n_lines": len(lines), "n_distinct_words": len(set(w)), "n_letters": sum(map(letter, t)), "n_ascii_letters": sum(c.isascii() and c.isalpha() for c in t), "n_upper": sum("A" <= c <= "Z" for c in t),
        "n_marks": sum(c in "!?" for c in t), "n_letter_words": sum(any(map(letter, x)) for x in w),
    }


def corpus(seed=1, good=240, bad=20):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßt") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n // 12 + 1))
    rows = [prose(rng.randint(60, 400)) for _ in range(good)]
    junk = [
        lambda: re.sub(r"(\S+)", lambda m: m[1] + rng.choice(["%%%", "***", "&&&"]), prose(120)),
        lambda: " | ".join(rng.choice(words) for _ in range(90)),
        lambda: prose(90).upper().replace(" ", "!! "),
        lambda: " ".join(f"{w} " * 20 for w in rng.sample(words, 10)),
    ]
    return [(i, t) for i, t in enumerate(rows)] + [(1000 + i, junk[i % 4]()) for i in range(bad)]


def vote(rule, c):
    x, of = 1000 * c[rule.top], c[rule.of]
    if of < rule.least:
        return 0
    bad, good = (x > rule.bad * of, x < rule.good * of) if not rule.reverse else (x < rule.bad * of, x > rule.good * of)
    return -1 if bad else 1 if good else 0


def accuracies(votes):
    """The estimate, one document after the other."""
    good, a, b = rules.START[0], [rules.START[1]] * len(rules.RULES), [rules.START[2]] * len(rules.RULES)

    def posterior(v):
        odds = math.log(good / (1 - good))
        for k, x in enumerate(v):
            if x and a[k] + b[k] > 1:
                odds += math.log(a[k] / (1 - b[k])) if x > 0 else math.log((1 - a[k]) / b[k])
        return 1 / (1 + math.exp(-odds))

    own = rules.WEIGHT * len(votes)
    for _ in range(rules.ROUNDS):
        p = [posterior(v) for v in votes]
        sums = [(sum(q for q, v in zip(p, votes) if v[k] > 0), sum(q for q, v in zip(p, votes) if v[k]), sum(1 - q for q, v in zip(p, votes) if v[k] < 0), sum(1 - q for q, v in zip(p, votes) if v[k])) for k in range(len(rules.RULES))]
        good = (sum(p) + own * rules.START[0]) / (len(votes) + own)
        a, b = [(s[0] + own * rules.START[1]) / (s[1] + own) for s in sums], [(s[2] + own * rules.START[2]) / (s[3] + own) for s in sums]
    return good, a, b, [posterior(v) for v in votes]


def test_counts():
    texts = ODD + [t for _, t in corpus(3, 12, 8)] + ["w " * 3 + "v" * 100_000]
    data, offsets = K.text_buffer(pa.array(texts))
    got = dict(zip(rules.COUNTS, rules.counts(data, offsets)))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute(t), repr(t)[:80]
    assert all(not len(x) for x in rules.counts(np.zeros(0, np.uint8), np.zeros(1, np.int64)))


def test_counts_with_many_distinct_words(monkeypatch):
    text = " ".join(str(i % 70_001) for i in range(140_010))
    data, offsets = K.text_buffer(pa.array([text, "a b a b a"]))
    want = [x.tolist() for x in rules.counts(data, offsets)]
    assert want[4] == [140_010, 5]
    monkeypatch.setattr(rules, "DIRECT", 10)
    assert [x.tolist() for x in rules.counts(data, offsets)] == want


def test_estimate_and_verdicts(make):
    rows = corpus() + [(2000 + i, t) for i, t in enumerate(ODD)]
    counts = [brute(t) for _, t in rows]
    votes = [[vote(r, c) for r in rules.RULES] for c in counts]
    good, a, b, posterior = accuracies(votes)
    got = {r.doc_id: r for r in rules.judged(make(rows)).collect()}
    assert len(got) == len(rows)
    for (i, _), c, p in zip(rows, counts, posterior):
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        r = got[i]
        assert [r[k] for k in rules.COUNTS[:5]] == [c[k] for k in rules.COUNTS[:5]]
        assert r.base_failed == failed and r.posterior == pytest.approx(p, abs=1e-9) and r.kept == (not failed and p >= rules.THRESHOLD)
    model = rules.learned(rules.counted(make(rows)))
    assert model.good == pytest.approx(good) and model.on_good.tolist() == pytest.approx(a) and model.on_bad.tolist() == pytest.approx(b)
    assert all(got[i].kept for i, t in rows[:240]) and not any(got[i].kept for i, _ in rows[240:260])
    assert sorted(r.doc_id for r in rules.kept(make(rows)).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_one_bad_vote_is_no_rejection(make):
    """All-must-pass would reject a page whose words are long; the estimate does not know such rules as reliable."""
    rows = corpus() + [(5000, "\n".join(" ".join(f"{'donaudampfschiff'}{i}{j}" for i in range(12)) for j in range(9)))]
    votes = [vote(r, brute(rows[-1][1])) for r in rules.RULES]
    assert -1 in votes and {r.doc_id: r for r in rules.judged(make(rows)).collect()}[5000].kept


def test_odd_rows(make):
    assert rules.judged(make([])).count() == 0 and rules.kept(make([])).columns == make([]).columns
    text = corpus()[0][1]
    got = rules.judged(make([(None, text), (1, text), (1, text), (2, None), (3, "")])).collect()
    assert sorted((r.doc_id or 0, r.kept, r.base_failed) for r in got) == [(0, True, False), (1, True, False), (1, True, False), (2, False, True), (3, False, True)]
    assert rules.kept(make([(None, text), (2, None)])).collect()[0].text == text
