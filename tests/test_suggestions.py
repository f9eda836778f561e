"""Name suggestions and containment by an index of character runs, against all pairs."""

import random

from barloom.operators import retrieval as V


def names(seed, n, letters="abcé 日"):
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 6, 9]))) for _ in range(n)))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_contained(spark):
    a, b = names(1, 150), names(2, 150) + ["", "a" * 4000 + "b"]
    needles, texts = spark.createDataFrame([(x,) for x in [*a, "", "aab"]], "needle string"), spark.createDataFrame([(x,) for x in b], "text string")
    found = V.contained(needles, texts)
    assert sorted((r.needle, r.text) for r in found.collect()) == sorted((x, y) for x in {*a, "aab"} for y in b if x in y)
    assert V.contained(needles.where("false"), texts).count() == V.contained(needles, texts.where("false")).count() == 0


def test_suggestions(spark):
    rng = random.Random(7)
    known = [x for n in names(3, 120) for x in {n, n.upper()} if rng.random() < 0.7] + [None]
    asked = names(4, 120) + [None, "", "  ", " ab ", "ABC", *[k for k in known[:10] if k]]
    rows, table = spark.createDataFrame([(x,) for x in asked * 2], "exercise_name string"), spark.createDataFrame([(x,) for x in known], "name string")
    out = V.suggestions(rows, table)
    lows = {x.lower() for x in known if x is not None}
    want = {}
    for x in asked:
        if x is not None and x.lower() in lows:
            continue
        low = (x or "").strip(" ").lower()
        want[x] = sorted({k for k in known if k and low and (low in k.lower() or k.lower() in low)}, key=lambda k: k.encode())[:3]
    assert {r.exercise_name: r.suggestions for r in out.collect()} == want
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
