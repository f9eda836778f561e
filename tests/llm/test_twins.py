"""The queries of operators 11 to 13 give the rows of their SQL at sf 0.001."""

import duckdb
import pytest

from barloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_weak_rules", "op12_divergence", "op13_prefix_trie"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    at = {d[0]: i for i, d in enumerate(found.description)}
    want = sorted((tuple(r[at[c]] for c in columns) for r in found.fetchall()), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want and want
