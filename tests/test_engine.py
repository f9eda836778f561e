"""Whole workloads, articles, retries, text cutting against plain versions, and sinks that run again."""

import json
import re

from pyspark.sql import functions as F

from barloom import engine
from barloom.operators import exports as X
from barloom.operators import jobs as J
from barloom.operators import sections as S
from barloom.operators.keywords import Tagger
from barloom.operators.store import Store
from barloom.plans import rules as P
from barloom.sources import articles as H
from barloom.sources import files
from barloom.streaming import ingest as I


def test_live_article():
    words = "<p>" + "word " * 60 + "</p>"
    html = f"<html><head><title>Long title - Notes - Site Name 3</title></head><body><nav>menu</nav><div class='sub_page_main_area_half_container_left'><h1>Heading one</h1><p>Jane Q. Doe</p><div class='seeAlso'>other</div>{words}</div></body></html>"
    title, author, text, status = H.live_article(html, "Nobody", r"\s*-\s*Notes\s*-\s*Site Name.*$")
    assert (title, author, status) == ("Heading one", "Jane Q. Doe", "ok") and "other" not in text and "menu" not in text and text.startswith("Heading one\n\nJane Q. Doe")
    title, author, text, status = H.live_article(f"<title>Real title | Site</title><body><header>x</header><article><p>ab</p><p>March 3, 2020</p>{words}", "Nobody", r"\s*\|.*$")
    assert (title, author, status) == ("Real title", "Nobody", "ok")
    assert H.live_article("<p>no container", "N")[3] == "skip" and H.live_article("<body><p>short</body>", "N")[3] == "skip" and H.live_article("", "N")[3] == "skip"


def test_archived_article():
    body = "<p>" + "Wörter " * 60 + "</p>"
    html = f"<h2 class='post-title'>The <b>title</b></h2><div class='entry-content'>{body}<ul class='share-links'><li>tweet</ul></div><main>other</main>"
    title, author, text, status = H.archived_article(html, "http://u", "Curator")
    assert (title, author, status) == ("The title", "Curator", "ok") and "tweet" not in text and "other" not in text
    assert H.archived_article("<body><p>short", "http://u", "C")[::3] == ("http://u", "retry")
    assert "ö" in H.decoded(html.encode()) and "ö" in H.decoded(("<meta charset=iso-8859-1>" + html).encode("latin-1")) and "ö" in H.decoded(html.encode("latin-1"))


def test_articles_of_bytes_and_nulls(spark):
    rows = [(1, "u", ("<article>" + "<p>line of words here</p>" * 20).encode()), (2, "u", None)]
    got = {r.page_id: r for r in H.articles(spark.createDataFrame(rows, "page_id int, url string, html binary")).collect()}
    assert got[1].status == "ok" and got[1].title == "line of words here" and got[2].status == "skip" and got[2].text == ""


def test_deep_pages_do_not_recurse_without_end():
    assert H.live_article("<div>" * 5000 + "x" + "</div>" * 5000, "N")[3] == "skip"


def test_retrying():
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if url == "flaky":
            return (503, None) if len(calls) < 3 else (200, "body")
        if url == "down":
            raise OSError("reset")
        return {"gone": 404, "busy": 429, "ok": 204}[url], "x"

    get = H.retrying(fetch, attempts=3, base=1.0, sleep=waits.append)
    assert get("flaky") == (200, "body", False) and waits == [2.0, 4.0]
    assert get("gone") == (404, None, True) and get("ok") == (204, "x", False) and len(waits) == 2
    assert get("busy") == (429, None, False) and get("down") == (0, None, False) and len(waits) == 6


def test_sections_whose_headers_span_lines():
    assert S.split_sections("#\nfoo bar\nbody") == [("", "#\nfoo bar", "body")]
    assert S.split_sections("intro\nChapter\n5 x\nbody\n## Two\n\n more ") == [("", "", "intro"), ("Chapter\n5 x", "Chapter\n5 x", "body"), ("Chapter\n5 x", "## Two", "more")]
    assert S.split_sections("") == [("", "", "")] and S.split_sections("# only") == [("", "", "# only")]
    assert S.split_sections("one\n1.2 About\n  Chapter 3 indented\nrest") == [("", "", "one")]


def plain_chunks(text, size, overlap):
    """Packing written out word by word, without the operator's shortcuts."""
    tokens = lambda t: int(len(t.split()) * 1.3)
    out, now, used = [], [], 0
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if now and used + tokens(p) > size:
            left, right = "\n\n".join(now)[-200:], p[:200]
            zone = left + "\n\n" + right
            if any(m.start() < len(left) < m.end() for k in S.KEEP_TOGETHER for m in re.finditer(k, zone)):
                now.append(p)
            else:
                out.append("\n\n".join(now))
                kept = []
                for s in reversed(re.split(r"(?<=[.!?])\s+", "\n\n".join(now))):
                    if tokens(" ".join([s, *kept])) > overlap:
                        break
                    kept.insert(0, s)
                now = [x for x in (" ".join(kept).strip(), p) if x]
            used = tokens("\n\n".join(now))
        else:
            now.append(p)
            used += tokens(p)
    return [*out, "\n\n".join(now)] if now else out


def test_chunks_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    bits = ["Squat 5x5 at 80%.", "Rest: 90", "1. one\n2. two\n", "Some words here!", "Week 3 is hard", "A sentence of seven words in all.", "Sets: 3", "70%/5 80%/3", "Monday:\n  Snatch 3x3\n"]
    texts = ["\n\n".join(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    for text in texts:
        for size, overlap in ((20, 5), (60, 20)):
            assert S.pack_paragraphs(text, size, overlap) == plain_chunks(text, size, overlap)
    rows = spark.createDataFrame([(i, t, 40, 10) for i, t in enumerate(texts)] + [(999, None, 40, 10)], "id int, content string, size int, overlap int")
    got = {}
    for r in S.chunks(rows).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append(r.raw_content)
    want = {i: [c for _, b in S.split_blocks(t) for c in plain_chunks(b, 40, 10)] for i, t in enumerate(texts)}
    assert got == {i: c for i, c in want.items() if c}


def test_classify_needs_its_words_only_as_a_shortcut(spark):
    texts = ["You should not exceed 5. Never go. Always start. " * 2, "a|b|c\n" * 3, "Power Snatch\nlift it", "Week 3:\n  a\n  b\n  c\n", "Monday\n  snatch 3x3\n  pull sets\n", "INCREASE it by 5. At Least 3. Rule of Thumb", "80% " + "word " * 120 + "reduce it to 5, no more than 3", "plain " * 60, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.c for r in S.classified(df, "x").orderBy("i").collect()]
    assert [c.type for c in got] == ["principle", "table", "exercise_description", "program_template", "program_template", "principle", "mixed", "prose", "prose"]
    assert got == [r.c for r in df.withColumn("c", S.classify(F.col("x"))).orderBy("i").collect()]


def test_html_blocks():
    assert files.main_text("<nav>x</nav><main><h1>T</h1>one<br>two<p>three</p><table><tr><td>a</td><td>b</td></tr></table></main>") == "T\n\none\ntwo\n\nthree\n\na\n\nb"
    assert files.main_text("<body><p>a &amp; b<script>no()</script></body>") == "a & b" and files.main_text(None) == ""
    assert files.main_text('<div class="x content">in</div><p>out</p>') == "in"


def test_vocabulary_and_tags(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"Clean Pull": ["pulling", "clean"], "jerk": ["jerk"]}))
    words = S.vocabulary(spark, f"file://{tmp_path}/v.json")
    df = spark.createDataFrame([(1, "the CLEAN pull"), (2, "jerky"), (3, "none"), (4, None)], "id int, text string")
    assert {r.id: r.topics for r in Tagger(spark, words).tagged(df, "id", "text").collect()} == {1: ["clean", "pulling"], 2: ["jerk"]}
    assert Tagger(spark, words.where("false")).tagged(df, "id", "text").count() == 0


def test_ingest_and_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Book One.txt").write_text("# Chapter 1 Start\n\n" + "Snatch is a lift. " * 40 + "\n\n# More\n\n" + "Rest is training too. " * 30)
    (tmp_path / "in" / "page.html").write_text("<main><p>" + "Recovery matters. " * 40 + "</main>")
    first = engine.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", {"snatch": ["snatch_technique"]}, "run-1").collect()
    assert [(r.run_id, r.chunks) for r in first] == [("run-1", 3)] and first[0].tokens > 100
    assert engine.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", {}, "run-2").collect() == []
    rows = Store(spark, f"file://{tmp_path}/out").read("chunks")
    assert rows.count() == 3 and {tuple(r.topics) for r in rows.collect()} >= {("snatch_technique",)}
    (tmp_path / "in" / "new.txt").write_text("Deload weeks are easy. " * 40)
    assert [r.chunks for r in engine.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", {}, "run-3").collect()] == [1]


def test_sources_dry_runs_and_retagging(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, word in (("One", "Snatch"), ("Two", "Deload")):
        (tmp_path / "in" / f"{name}.txt").write_text(f"{word} is a word of the text. " * 40)
    at, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    store = Store(spark, to)
    seen = engine.ingest(spark, at, to, {}, "dry", author="A. Writer", dry_run=True).collect()
    assert [r.chunks for r in seen] == [2] and store.version() == 0
    engine.ingest(spark, at, to, {}, "run", author="A. Writer", doc_type="program")
    assert store.version() == 1
    sources = {r.title: r for r in store.read("sources").collect()}
    assert {(r.author, r.source_type) for r in sources.values()} == {("A. Writer", "manual")} and set(sources) == {"One", "Two"}
    chunks = store.read("chunks").select("source_id", "raw_content", "topics").collect()
    assert {r.source_id for r in chunks if "Snatch" in r.raw_content} == {sources["One"].id} and all(not r.topics for r in chunks)
    words = {"snatch": ["lifts"], "deload": ["rest"], "word": ["words"]}
    counts = lambda *a, **k: tuple(engine.retag(spark, to, *a, **k).first())
    assert counts(words, dry_run=True) == (2, 2, 2) and store.version() == 1
    assert counts(words, source_id=sources["One"].id) == (1, 1, 1) and store.version() == 2
    assert counts(words) == (2, 1, 1) and counts(words) == (2, 0, 0) and store.version() == 3
    assert counts({"word": ["words"]}) == (2, 2, 0)
    assert sorted(tuple(r.topics) for r in store.read("chunks", 3).collect()) == [("lifts", "words"), ("rest", "words")]
    assert engine.ingest(spark, at, to, {}, "again", author="A. Writer").collect() == [] and store.read("sources").count() == 2


def test_load_batch_after_a_crash_between_its_writes(spark, tmp_path):
    target, ledger = f"file://{tmp_path}/t", f"file://{tmp_path}/l"
    batch = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, " ")], "position long, raw_content string")
    I.load_batch(spark, target)(batch, 7)  # the ledger is not written
    I.load_batch(spark, target, ledger)(batch, 7)
    I.load_batch(spark, target, ledger)(batch, 7)
    assert spark.read.parquet(target).count() == 2 and spark.read.parquet(ledger).count() == 2
    I.load_batch(spark, target, ledger)(batch.union(spark.createDataFrame([(5, "three")], batch.schema)), 8)
    assert sorted(r.batch_id for r in spark.read.parquet(ledger).collect()) == [7, 7, 8]


def test_embedding_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        assert len(texts) <= I.EMBED_BATCH and max(map(len, texts)) <= I.EMBED_CHARS
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(250).repartition(1).select("id", F.when(F.col("id") == 3, F.repeat(F.lit("x"), 40_000)).otherwise("ab").alias("content"))
    got = {r.id: r.embedding for r in I.embedded_in_batches(rows, embed, "id").collect()}
    assert len(got) == 250 and got[3] == [30_000.0, 1.0] and got[4] == [2.0, 1.0] and calls.value == 3


def test_plan_for_all_athletes(spark):
    rows = [(1, "beginner", "general_strength", None, 3, None, None, None, None), (2, "elite", "competition_prep", "2026-02-20", 4, "accumulation", 95.0, 0.9, 0.2), (3, "advanced", "general_strength", None, 5, "accumulation", 50.0, 0.6, 0.2)]
    df = spark.createDataFrame(rows, "athlete_id int, level string, goal string, event_date string, sessions_per_week int, previous_phase string, adherence_pct double, make_rate double, rpe_deviation double").withColumn("event_date", F.to_date("event_date"))
    got = engine.plan(df, F.lit("2026-01-01").cast("date")).collect()
    by = {}
    for r in got:
        by.setdefault(r.athlete_id, []).append(r)
    assert {a: (rs[0].phase, len(rs)) for a, rs in by.items()} == {1: ("accumulation", 4), 2: ("intensification", 4), 3: ("accumulation", 4)}
    assert all(r.intensity_ceiling <= 75 for r in by[1]) and all(r.total_reps > 0 for r in got)


def pdf(pages, compress=True, cmap=False):
    """A small PDF with one content stream a page."""
    import zlib

    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>".encode()}
    objects[3] = b"<< /Type /Font /BaseFont /Helvetica" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>"
    table = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <0062> endbfrange"
    objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    for i, text in enumerate(pages):
        data = zlib.compress(text) if compress else text
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items(), reverse=True)) + b"%%EOF"


def test_pdf_readers(spark, tmp_path):
    import pytest

    from barloom.sources import pdf as D

    first = rb"BT /F1 12 Tf 72 700 Td (Front \(squat\) \351) Tj 0 -14 Td [(5 x) -300 (5)] TJ T* <414243> Tj ET"
    made = pdf([first, b"BT (page two) Tj ET", b"q Q"])
    assert D.by_page_tree(made) == ["Front (squat) é\n5 x 5\nABC", "page two", ""] and D.by_page_tree(pdf([first], compress=False)) == ["Front (squat) é\n5 x 5\nABC"]
    assert D.by_page_tree(pdf([b"BT /F1 9 Tf <010203> Tj ET"], cmap=True)) == ["Abc"]
    broken = made.replace(b"/Type /Page", b"/Type /Pxge")
    assert D.by_page_tree(broken) == [] and sorted(D.by_streams(broken)) == ["Front (squat) é\n5 x 5\nABC", "page two"]
    assert sorted(D.read_pdf(broken)) == sorted(D.by_streams(broken))
    for bad in (b"no pdf", made + b"/Encrypt 9 0 R"):
        with pytest.raises(ValueError):
            D.by_page_tree(bad)
    (tmp_path / "a.pdf").write_bytes(pdf([b"BT (" + b"word " * 40 + b") Tj ET", b"BT (two) Tj ET"]))
    got = files.extract(spark, f"file://{tmp_path}/a.pdf", max_pages=1).collect()
    assert [(r.page, r.text[:9]) for r in got] == [(0, "word word")]


def test_commands(spark, tmp_path):
    import pytest

    at = lambda n: f"{tmp_path}/{n}"
    spark.createDataFrame([(1, 1, "a"), (None, 2, "b")], "session_id long, log_id long, notes string").write.parquet(at("logs"))
    (tmp_path / "changes.json").write_text('{"session_id": 1, "log_id": 1, "notes": "new"}\n{"log_id": 3, "notes": "c"}\n')
    engine.main(["log-session", at("logs"), at("changes.json"), at("out")])
    assert sorted((r.log_id, r.notes) for r in spark.read.parquet(at("out")).collect()) == [(1, "new"), (2, "b"), (3, "c")]
    spark.createDataFrame([(7, 1, 80.0, 8.0)], "planned_id long, session_id long, planned_kg double, rpe_target double").write.parquet(at("plan"))
    (tmp_path / "entries.json").write_text('{"log_id": 1, "session_id": 1, "planned_id": 7, "weight_kg": 82.5, "rpe": 9.0}\n{"log_id": 1, "session_id": 2, "planned_id": 7, "weight_kg": 1.0, "rpe": 9.0}\n')
    engine.main(["log-exercise", at("entries.json"), at("plan"), at("out2")])
    assert sorted(((r.planned_id, r.weight_deviation_kg, r.rpe_deviation) for r in spark.read.parquet(at("out2")).collect()), key=str) == [(7, 2.5, 1.0), (None, None, None)]
    with pytest.raises(SystemExit):
        engine.main(["nothing"])


def test_csv_fields_and_deadline(spark):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "plain"), (4, "two\nlines")], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(X.csv_line(F.col("x"), F.lit("z"))).collect()] == ['"a ""b"", c",z', ",z", "plain,z", '"two\nlines",z']
    at = spark.sql("SELECT TIMESTAMP '2026-01-01 00:00:00' AS t").select(J.deadline(F.col("t")).cast("string")).first()[0]
    assert at == "2026-01-01 00:09:30"
    assert P.MEASURES.keys() == {"adherence", "make_rate", "rpe_deviation"}
