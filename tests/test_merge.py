"""Upserts whose changes repeat a key."""

import pytest

from barloom.operators import merge as M


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_key_that_changes_have_twice(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "id long, name string")
    changes = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, "c", 7), (3, "d", 1), (None, "e", 1), (None, "f", 1)], "id long, name string, at int")
    with pytest.raises(Exception, match=r"key \(id\) twice: 1"):
        M.upsert(table, changes, ["id"]).collect()
    want = [(1, "b"), (2, "y"), (3, "d"), (None, "e"), (None, "f"), (None, "n")]
    assert rows(M.upsert(table, changes, ["id"], order=["at"])) == sorted(want, key=str)
    assert rows(M.upsert(table, changes.where("at > 8 OR id IS NULL"), ["id"], {"name": M.curated})) == sorted([(1, "x"), (2, "y"), (None, "e"), (None, "f"), (None, "n")], key=str)
    assert rows(M.upsert(table, changes.select("id").distinct(), ["id"], order=["id"])) == sorted([(1, "x"), (2, "y"), (3, None), (None, None), (None, "n")], key=str)


def test_a_tie_has_one_result(spark):
    ties = [(1, "a", [2], 5), (1, "b", [1], 5), (1, "c", None, 5), (1, "z", None, 4), (2, "a", [2, 3], 1), (2, "a", [9], 1)]
    for own in (ties, ties[::-1]):
        for parts in (1, 3):
            found = M.one_a_key(spark.createDataFrame(own, "id long, name string, x array<int>, at int").repartition(parts), ["id"], ["at"])
            assert rows(found) == [(1, "c", None, 5), (2, "a", [9], 1)]
    maps = spark.createDataFrame([(1, {"k": 1}, 5), (1, {"k": 2}, 7)], "id long, m map<string,int>, at int")
    assert rows(M.one_a_key(maps, ["id"], ["at"])) == [(1, {"k": 2}, 7)]
