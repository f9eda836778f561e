"""Source upsert against one row after the other."""

import hashlib
import random

import pytest

from barloom.operators import source_upsert as U

SOURCES = "id long, title string, author string, source_type string, url string, note string"
ROWS = "position long, title string, author string, source_type string, url string, more int"


def one_by_one(sources, rows):
    """(sources, id by position) as a loop over the rows, with dictionaries by URL and by title."""
    first_id = max((s[0] for s in sources), default=0) + 1
    stored = {s[0]: dict(zip(("id", "title", "author", "kind", "url"), s)) for s in sources}
    for s in stored.values():
        s["url"] = (s["url"] or "").strip()
    said = {}
    for position, title, author, kind, url in sorted(r[:5] for r in rows):
        url, title = (url or "").strip(), title[:300]
        by_url = {s["url"]: i for i, s in stored.items() if s["url"]}
        by_name = {(s["title"], s["author"]): i for i, s in stored.items()}
        known = by_url.get(url) if url else None
        if known is None:
            known = by_name.get((title, author))
            if known is not None and url and stored[known]["url"] not in ("", url):
                names = [("%s [%s]" % (title, [p for p in url.split("/") if p][-1]))[:300], "%s [%s]" % (title[:289], hashlib.md5(url.encode()).hexdigest()[:8])]
                title = names[1] if names[0] == title or (names[0], author) in by_name else names[0]
                known = by_name.get((title, author))
        if known is None:
            known = first_id + position
            stored[known] = {"id": known, "title": title, "author": author, "kind": kind, "url": url}
        said[position] = known
        stored[known]["url"] = stored[known]["url"] or url
    return sorted((s["id"], s["title"], s["author"] or "", s["kind"], s["url"]) for s in stored.values()), said


def compare(spark, sources, rows):
    after, ids = U.upserted(spark.createDataFrame([(*s, "kept") for s in sources], SOURCES), spark.createDataFrame([(*r, 1) for r in rows], ROWS))
    want, said = one_by_one(sources, rows)
    got = after.collect()
    assert after.columns == [c.split()[0] for c in SOURCES.split(", ")]
    assert sorted((r.id, r.title, r.author or "", r.source_type, r.url or "") for r in got) == want
    assert {r.position: r.source_id for r in ids.collect()} == said
    old = {s[0] for s in sources}
    assert {r.note for r in got if r.id in old} <= {"kept"} and {r.note for r in got if r.id not in old} <= {None}


@pytest.mark.parametrize("seed,brackets", [(1, False), (2, True), (3, True)])
def test_rows_see_what_earlier_rows_made(spark, seed, brackets):
    rng = random.Random(seed)
    titles = ["Home", "About", "Log", "x" * 299, "x" * 300] + (["Home [a]", "Home [b]", "Log [2] [a]", "Log [2]"] if brackets else [])
    urls = [None, "", " ", *(f"https://h{i % 3}/{2010 + i}/{rng.choice('abc')}{'/' * (i % 2)}" for i in range(25))]
    sources = [(5, "Home", "cj", "website", None), (9, "About", "cj", "book", "https://h0/1/a"), (11, "Old", "cj", "book", "https://h1/2/b"), (12, "Log", None, "book", None)]
    sources += [(20, "Home [c]", "cj", "book", "https://h9/c")] if brackets else []
    rows = [(i, rng.choice(titles), rng.choice(["cj", "cj", None]), rng.choice(["book", "website"]), rng.choice(urls)) for i in range(120)]
    rows += [(200, "New name", "cj", "book", "https://h0/1/a"), (201, "Old", "cj", "book", "https://h7/b/")]
    compare(spark, sources, rows)


def test_many_pages_of_one_title(spark):
    rows = [(i, "Untitled", "cj", "website", f"https://h/{i}/{i % 400}") for i in range(2000)]
    compare(spark, [(1, "Untitled", "cj", "website", None)], rows[:300])
    after, ids = U.upserted(spark.createDataFrame([], SOURCES), spark.createDataFrame([(*r, 1) for r in rows], ROWS))
    assert after.count() == ids.select("source_id").distinct().count() == 2000 and after.select("title").distinct().count() == 2000


def test_nothing(spark):
    compare(spark, [(1, "a", "b", "book", None)], [])
    compare(spark, [], [(0, "a", None, "book", None), (1, "a", None, "book", None)])
