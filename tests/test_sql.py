"""The table functions of SQL against the functions on texts."""

import pytest

from barloom.operators import sections as S
from barloom.sql import register

TEXT = "Intro text.\n# Chapter 1 Basics\nBody one.\n\nMore.\nWeek 3 Load\nHeavy.\n## Part\nBody two."
ROWS = [(1, "a", TEXT), (2, "b", ""), (3, "c", None), (4, "d", "plain"), (5, "e", "# Only a heading")]


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    spark.createDataFrame(ROWS, "id long, tag string, text string").createOrReplaceTempView("udtf_docs")
    return spark.sql


def test_sections(sql):
    got = sorted(map(tuple, sql("SELECT * FROM sections(TABLE(udtf_docs))").collect()))
    assert got == sorted((i, tag, n, *s) for i, tag, t in ROWS for n, s in enumerate(S.split_sections(t or "")))
    assert sql("SELECT * FROM sections(TABLE(udtf_docs))").dtypes == [("id", "bigint"), ("tag", "string"), ("ordinal", "int"), ("chapter", "string"), ("title", "string"), ("content", "string")]


def test_blocks_of_another_column(sql):
    got = sql("SELECT id, ordinal, title, content FROM text_blocks(TABLE(SELECT id, text AS body FROM udtf_docs), column => 'BODY')").collect()
    assert sorted(map(tuple, got)) == sorted((i, n, *s) for i, _, t in ROWS for n, s in enumerate(S.split_blocks(t or "")))


def test_packed_chunks(spark, sql):
    said = ["Sentence one is here. Sentence two follows it! Three?", "A short one.", "Reps 5x3 @ 80% of max", "then 3x3 @ 85%", "  ", None, "x " * 200, "Last one.\n\nAnd another paragraph."]
    rows = [(d, n, t) for d in range(3) for n, t in enumerate(said[d:])]
    spark.createDataFrame(rows[::-1], "doc long, n int, text string").createOrReplaceTempView("udtf_lines")
    call = "SELECT doc, ordinal, content FROM packed_chunks(TABLE(SELECT doc, n, text FROM udtf_lines) PARTITION BY doc ORDER BY n, size => {}, overlap => {})"
    for size, overlap in ((20, 8), (60, 0), (1000, 50)):
        got = sql(call.format(size, overlap)).collect()
        want = [(d, i, c) for d in range(3) for i, c in enumerate(S.pack_paragraphs("\n\n".join(t or "" for t in said[d:]), size, overlap))]
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(
    "call,says",
    [
        ("sections(TABLE(SELECT id FROM udtf_docs))", "no column 'text'"),
        ("sections(TABLE(SELECT text, 1 AS title FROM udtf_docs))", "column title"),
        ("text_blocks(TABLE(udtf_docs), column => 'id')", "no text"),
        ("packed_chunks(TABLE(udtf_docs) PARTITION BY id, size => -1, overlap => 0)", "size is a constant"),
    ],
)
def test_refused_when_analysed(sql, call, says):
    with pytest.raises(Exception, match=says):
        sql(f"SELECT * FROM {call}")
