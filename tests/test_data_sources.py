"""Python data sources: a crawl that goes on from its checkpoint, and writes that commit in units or not at all."""

import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from barloom.sources import web
from barloom.streaming import committed as C
from barloom.streaming import state

SITE = os.environ.setdefault("BARLOOM_TEST_SITE", "/tmp/barloom-test-site.json")


def fetch(url):
    """A listing of as many pages as the file says; each page has three articles, one of them also on the page before."""
    with open(url.split("?")[0].removeprefix("http:")) as f:
        site = json.load(f)
    at = int(url.partition("start=")[2]) // 20
    with open(site["log"], "a") as log:
        log.write(f"{at} ")
    if at >= site["pages"]:
        return 404, ""
    links = "".join(f'<a href="/article/{i}/x">' for i in range(2 * at, 2 * at + 3))
    return 200, links + (f'<a href="?c=1&start={20 * (at + 1)}">' if at + 1 < site["pages"] else "")


def site(tmp_path, pages):
    (tmp_path / "site.json").write_text(json.dumps({"pages": pages, "log": str(tmp_path / "log")}))
    return f"http:{tmp_path}/site.json"


@pytest.mark.parametrize("pages", [1, 2, 3, 4, 7, 8, 9, 33])
def test_pages_are_counted_with_few_requests(tmp_path, pages):
    listing = web.Listing({"path": site(tmp_path, pages), "step": "20", "fetch": "tests.test_data_sources:fetch"})
    for known in {0, 1, pages // 2, pages}:
        (tmp_path / "log").write_text("")
        assert listing.count(known) == pages
        assert len((tmp_path / "log").read_text().split()) <= 14


def crawl(spark, tmp_path, url, **options):
    web.register(spark)
    df = spark.readStream.format("barloom_crawl").options(step="20", pagesPerTask="2", fetch="tests.test_data_sources:fetch", **options).load(url)
    at = str(tmp_path / "pages")
    df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination(200)
    return sorted(r.position for r in spark.read.schema(df.schema).parquet(f"{at}/rows").collect())


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path):
    url = site(tmp_path, 3)
    assert crawl(spark, tmp_path, url, pages="2") == [0, 1]  # stopped after two pages
    assert crawl(spark, tmp_path, url) == [0, 1, 2]
    site(tmp_path, 8)  # pages come while nobody reads
    assert crawl(spark, tmp_path, url) == list(range(8))
    assert crawl(spark, tmp_path, url) == list(range(8))


def test_every_article_once(spark, tmp_path):
    at, url = str(tmp_path / "links"), site(tmp_path, 2)
    for pages in (2, 5):
        site(tmp_path, pages)
        df = web.crawled_links(spark, url, "https://x.example", "tests.test_data_sources:fetch", step="20")
        writer = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        state.started(writer, spark).awaitTermination(200)
        urls = [r.url for r in spark.read.schema(df.schema).parquet(f"{at}/rows").collect()]
        assert sorted(urls) == sorted(f"https://x.example/article/{i}/x" for i in range(2 * pages + 1))


SCHEMA = "id long, name string"


def files(path):
    return sorted(p.name for p in pathlib.Path(path).rglob("*.parquet"))


def test_units_and_audit_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 230, 1, 2).select("id", F.concat(F.lit("n"), "id").alias("name"))
    C.write(df, path)
    C.write(df.where("id < 7"), path)
    assert sorted(r.id for r in C.rows(spark, path, SCHEMA).collect()) == sorted([*range(230), *range(7)])
    assert C.rows(spark, path, "name string").where("name = 'n3'").count() == 2
    found = C.audit(spark, path)
    assert sorted(r.n_rows for r in found.collect()) == sorted([50, 50, 15] * 2 + [7])
    assert sorted(r.file.split("/")[-1] for r in found.collect()) == files(path)


def test_a_failed_task_leaves_neither_rows_nor_audit_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    C.write(spark.range(0, 60, 1, 1).selectExpr("id", "'a' AS name"), path)
    before = files(path)
    bad = F.when(F.col("id") == 390, F.raise_error(F.lit("a bad row"))).otherwise(F.lit("b"))
    # one task fails late, after units of its own and of others are written
    with pytest.raises(Exception, match="a bad row"):
        C.write(spark.range(0, 400, 1, 4).select("id", bad.alias("name")), path)
    assert files(path) == before and len(before) == 2
    assert C.rows(spark, path, SCHEMA).count() == 60 and C.audit(spark, path).agg(F.sum("n_rows")).first()[0] == 60
    with pytest.raises(Exception, match="appends"):
        spark.range(1).write.format("barloom_committed").mode("overwrite").save(path)


def test_a_batch_commits_once(spark, tmp_path):
    folder = C.Folder(str(tmp_path / "t"))
    import pyarrow as pa

    part = lambda n: iter([pa.RecordBatch.from_pydict({"id": list(range(n)), "name": ["x"] * n})])
    C.committed(folder, "q-1", [C.units_of(folder, part(5), 2), None])
    (tmp_path / "t/audit/q-1.json").unlink()  # stopped between commit and audit
    C.committed(folder, "q-1", [C.units_of(folder, part(9), 2)])
    assert sorted(r.id for r in C.rows(spark, str(tmp_path / "t"), SCHEMA).collect()) == list(range(5))
    assert [r.n_rows for r in C.audit(spark, str(tmp_path / "t")).orderBy("unit").collect()] == [2, 2, 1] and len(files(tmp_path)) == 3


def test_as_a_stream_sink(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "t")
    C.register(spark)
    for i in range(2):
        spark.range(100 * i, 100 * i + 60).selectExpr("id", "'s' AS name").coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(SCHEMA).parquet(src)
        df.writeStream.format("barloom_committed").option("path", path).option("query", "q").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    assert sorted(r.id for r in C.rows(spark, path, SCHEMA).collect()) == [*range(60), *range(100, 160)]
    assert sorted(r.n_rows for r in C.audit(spark, path).collect()) == [10, 10, 50, 50]


def test_many_units_are_few_tasks_and_entries(spark, tmp_path):
    path = str(tmp_path / "t")
    C.write(spark.range(0, 3005, 1, 2).selectExpr("id", "'a' AS name"), path, 5)
    back = C.rows(spark, path, SCHEMA)
    assert back.rdd.getNumPartitions() <= 4
    assert sorted(r.id for r in back.collect()) == list(range(3005))
    found = C.audit(spark, path).orderBy("unit").collect()
    assert [r.unit for r in found] == list(range(602)) and sorted({r.file.split("/")[-1] for r in found}) == files(path)
    assert sum(r.n_rows for r in found) == 3005 and sorted(r.n_rows for r in found)[:3] == [2, 3, 5]
    (manifest,) = (tmp_path / "t/commits").glob("write-*.json")
    assert len(manifest.read_text()) < 500
