"""Every query with SQL gives the rows of its twin at sf 0.001."""

import datetime
import decimal
import math

import duckdb
import pytest

from barloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=key) == want
