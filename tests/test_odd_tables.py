"""Queries against their SQL on small tables of odd values."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from barloom.queries import ORACLE_SQL, QUERIES
from barloom.sources import articles, files
from barloom.streaming import state


def both(spark, tmp_path, name, table, columns):
    """Rows of a query and of its SQL over one table, sorted."""
    at = f"{tmp_path}/{table}.parquet"
    pq.write_table(pa.table(columns), at)
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view {table} as select * from read_parquet('{at}')")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.execute(ORACLE_SQL[name])
    want = [dict(zip([d[0] for d in found.description], r)) for r in found.fetchall()]
    key = lambda r: str(sorted(r.items()))
    return sorted((r.asDict() for r in df.collect()), key=key), sorted(want, key=key)


def pages(heads):
    """Pages with a title and heading of each text."""
    body = "word &quot;two&quot; &amp; three " * 10
    return {"page_id": list(range(len(heads))), "url": ["http://u"] * len(heads), "html": [f"<html><head><title>{h}</title></head><body><nav>m</nav><article><h1>{h}</h1><p>{body}&quot<br><p>&quote x</p></article></body></html>" for h in heads]}


def heads():
    """Headings cut inside a reference."""
    return [f"Some heading {ref[:n]}" for ref in ("&amp;", "&quot;") for n in range(len(ref) + 1)] + ["&quot", "&amp", "A &ampb &quotc;"]


def test_references_without_semicolons():
    assert files.main_text("<p>&quot;a&quot; &eacute;&#39;&#x41;</p>") == "\"a\" é'A"
    assert files.main_text("<p>a &quot</p><p>b=1&copy=2 &nosuch; &quotc; &</p>") == "a &quot\n\nb=1&copy=2 &nosuch; &quotc; &"
    assert files.main_text("<p>a &amp</p><p>&ampb &amp;quot</p>") == "a &\n\n&b &quot"
    assert files.main_text("<div class='a&copy=b'><main>x</main></div>") == "x"


def test_html_text_of_cut_headings(spark, tmp_path):
    got, want = both(spark, tmp_path, "html_text", "pages", pages(heads()))
    assert got == want


def test_live_articles_of_cut_headings(spark, tmp_path):
    got, want = both(spark, tmp_path, "live_articles", "pages", pages(heads()))
    assert got == want


def test_titles_without_semicolons():
    page = "<title>Notes on &quot</title><h1 class='entry-title'>&quot;Old&quot; &copy=1</h1><article><p>ab</p><p>c &amp</p></article>"
    assert articles.live_article(page, "N")[:3] == ("Notes on &quot", "N", "ab\n\nc &")
    assert articles.archived_article(page, "http://u", "C")[0] == '"Old" &copy=1'


def events(groups):
    """Events of an hour each at the end of January, a user for each list of values; every id is divisible by 6."""
    rows = [(user, v) for user, own in enumerate(groups) for v in own]
    n = len(rows)
    return {"event_id": [6 * i for i in range(n)], "ts": [datetime.datetime(2024, 1, 29) + datetime.timedelta(minutes=i) for i in range(n)], "user_id": [r[0] for r in rows], "event_type": ["view"] * n, "value": [r[1] for r in rows], "props": ["{}"] * n}


def test_warnings_list_of_means_next_to_a_half(spark, tmp_path):
    rng = random.Random(4)
    # means of 1.65, 1.75, ... whose sums end a bit above or below
    groups = []
    for _ in range(300):
        own, total = [round(rng.uniform(20, 50), 2) for _ in range(rng.randint(2, 9))], rng.randint(16, 24) * 2 + 1
        groups.append([*own, round(total * (len(own) + 1) - sum(own), 2)])
    got, want = both(spark, tmp_path, "warnings_list", "events", events(groups))
    assert got == want and sum(r["kind"] == "effort_above_target" for r in got) > 200


def test_warning_starts_of_means_at_a_threshold(spark, tmp_path):
    rng = random.Random(5)
    # decimals with a mean of 0.7, reached from above by the last value: as doubles some are below
    groups = []
    for _ in range(150):
        own = [round(rng.uniform(71, 90), 2) for _ in range(rng.randint(2, 5))]
        groups.append([*own, round(70 * (len(own) + 1) - sum(own), 2)])
    got, want = both(spark, tmp_path, "warning_starts", "events", events([*groups, [1.0] * 1440]))
    assert got == want and 10 < sum(r["value"] == 0.7 for r in got) < 140


def test_events_of_one_time_add_up_in_one_order():
    own = [(0, None, m) for m in (0.7, 0.82, 0.58, 0.1, 0.3)] + [(0, e, None) for e in (2.95, 0.1, 0.2)]
    orders = {tuple(sorted(p, key=state.in_time)) for p in (own, own[::-1], own[3:] + own[:3])}
    assert len(orders) == 1 and state.mean_of_doubles([0.1] * 10) == 0.09999999999999999 and state.mean_of_doubles([]) is None
