"""The pipeline stage by stage against brute force, on a small folder with odd rows."""

import base64
import hashlib
import random

import pytest

import corpus_pipeline
from barloom.llm import quality
from barloom.llm.queries import ranks_file

from .conftest import LONG, copies, docs
from .test_models import jaccard, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    say = lambda k: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(k))
    rows, marks = [], []
    for i in range(160):
        good = i % 5 > 0
        body = say(rng.randint(25, 60))
        rows.append((i, body.capitalize() + "." if good else " ".join(w + "$$$" for w in body.split()), f"s{i % 3}"))
        marks.append((i, int(good)))
    rows += [(200 + i, rows[1][1] if i % 2 else rows[1][1].upper(), "hot") for i in range(12)]
    for i in range(20):
        w = rows[2][1].split()
        w[i % len(w)] = "changed"
        rows.append((300 + i, " ".join(w), "hot"))
    rows += [(400, None, None), (401, "", "s1"), (402, LONG, "s1"), (403, LONG, "s2"), (None, rows[3][1], "s0"), (1, rows[1][1], "s1")]
    top = tmp_path_factory.mktemp("sf")
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs0 = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs0, folder).cache()
    scored = quality.score(docs0, spark.read.parquet(f"{folder}/labels.parquet"))
    assert good.columns == docs0.columns and ids(good) == ids(scored.where("predicted = 1"))
    assert sum(i % 5 == 0 and i < 160 for i in ids(good) if i is not None) <= 1 and len([i for i in ids(good) if i is not None and i < 160 and i % 5]) >= 126

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    exact = steps["exact_dedup"](spark, good, folder).cache()
    best = {}
    for r in good.collect():
        t = (r.text or "").translate(low)
        best[t] = max((r.doc_id, best.get(t)), key=lambda x: -1 if x is None else x)
    assert exact.columns == docs0.columns and ids(exact) == sorted(best.values(), key=str)

    near = steps["near_dedup"](spark, exact, folder).cache()
    rows = exact.collect()
    w = [words(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if w[i] and w[j] and group[i] != group[j] and jaccard(w[i], w[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    keep = {}
    for g, r in zip(group, rows):
        if r.doc_id is not None:
            keep[g] = min(r.doc_id, keep.get(g, r.doc_id))
    assert near.columns == docs0.columns and ids(near) == sorted(keep.values(), key=str)

    mixed = steps["mixing"](spark, near, folder).cache()
    assert mixed.columns == docs0.columns and ids(mixed) == sorted((c[0] for c in copies([(r.doc_id, r.text, r.source) for r in near.collect()])), key=str)

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text or "" for r in near.collect()}
    out = steps["encoding"](spark, mixed, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    for r in out:
        assert r.token_ids == enc.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_stages_on_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
