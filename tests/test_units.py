"""Pinned values of functions, rules, text operators, sinks, sources and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from barloom.functions import collections as C
from barloom.functions import dates as D
from barloom.functions import numbers as N
from barloom.functions import text as T
from barloom.operators import analytics as A
from barloom.operators import merge as M
from barloom.operators import relational as R
from barloom.operators import retrieval as V
from barloom.operators import sections as S
from barloom.operators.keywords import Tagger
from barloom.plans import rules as P
from barloom.plans import validation as L
from barloom.sources import files, web
from barloom.streaming import ingest as I


def column(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    assert column(spark, "double", [72.3, 72.24, 100.0, 0.0, 72.25], N.round_kg) == [72.5, 72.0, 100.0, 0.0, 72.0]
    assert column(spark, "double", [65.0, 73.0, 85.0, 95.0, 105.0, 50.0, 80.0], P.zone_of) == ["65-70", "70-80", "80-90", "90-100", "90-100", None, "80-90"]
    assert column(spark, "string", ["3", "3,2,1", "8-10", "", "abc", None], N.representative_reps) == [3.0, 2.0, 9.0, None, None, None]
    assert column(spark, "string", ["1.5", "nan", "inf", "10000", "x", None], N.bounded_float) == [1.5, None, None, None, None, None]
    assert column(spark, "string", ["7", "0", "2.5", "41"], lambda c: N.bounded_int(c, 1, 40)) == [7, None, None, None]
    assert column(spark, "string", ["75", "2.9", "true", "75.0"], N.strict_int) == [75, None, None, 75]
    assert column(spark, "array<int>", [[3, 3, 2], [3], []], lambda c: N.dual_reps(F.lit(3), c)) == [8, 9, 0]


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert column(spark, "date", [None], lambda c: D.week_index(day("2026-01-01"), day("2026-01-16"), F.lit(12))) == [3]
    assert column(spark, "date", [None], lambda c: D.week_index(day("2026-01-01"), day("2027-01-01"), F.lit(4))) == [4]
    today = day("2026-05-10")
    said = column(spark, "string", ["2026-05-07", "2026-06-09", "2025-04-30", "garbage", None], lambda c: D.clamped_log_date(c, today).cast("string"))
    assert said == ["2026-05-07", "2026-05-10", "2026-05-10", "2026-05-10", "2026-05-10"]
    zones = column(spark, "string", ["Asia/Tokyo", "Nowhere/X", None], lambda c: D.today_in(F.lit("2024-01-01 20:00:00").cast("timestamp"), c, ["Asia/Tokyo"]).cast("string"))
    assert zones == ["2024-01-02", "2024-01-01", "2024-01-01"]


def test_collections(spark):
    assert column(spark, "string", ["1, 2,3", "1,99", "", "x"], lambda c: C.bounded_ints(c, 1, 20)) == [[1, 2, 3], [], [], []]
    assert column(spark, "array<int>", [[3, 1, 3, 2]], lambda c: C.first_seen(c, F.array(F.lit(9)), most=3)) == [[3, 1, 2]]
    assert column(spark, "array<int>", [[1, None], [5]], lambda c: C.overlaps(c, F.array(F.lit(2)))) == [False, False]
    rules = ['{"phase": "a"}', '{"phase": ["a"]}', '{"phase": null}', "{}", None]
    assert column(spark, "string", rules, lambda c: C.open_or_equal(F.try_parse_json(c), "$.phase", F.lit("a"))) == [True, False, True, True, True]
    assert column(spark, "string", ['{"l": ["x"]}', '{"l": "x"}', '{"l": null}', "{}"], lambda c: C.open_or_contains(F.try_parse_json(c), "$.l", F.lit("x"))) == [True, True, False, True]
    assert column(spark, "string", ['{"w": {"lte": 5}}', '{"w": {"lte": 2, "gt": 1}}', "{}"], lambda c: C.compares(F.try_parse_json(c), "$.w", F.lit(3.0))) == [True, False, True]
    got = column(spark, "string", ['{"a": 3}', None, '{"a": "x"}'], lambda c: C.with_defaults(c, "a double, b string", a=100.0, b="no"))
    assert [tuple(g) for g in got] == [(3.0, "no"), (100.0, "no"), (100.0, "no")]


def test_text(spark):
    assert column(spark, "string", ["Clean & Jerk", "Back Squat", "Odd Lift & Co"], T.lift_ref) == ["clean_and_jerk", "back_squat", "odd_lift_and_co"]
    assert column(spark, "string", ["do snalch at 9O% of lRM", "permIRMs", "hy- pertrophy"], T.corrected) == ["do snatch at 90% of 1RM", "permIRMs", "hypertrophy"]
    assert column(spark, "string", ["=1", "+a", "-b", "@c", "ok", None], T.csv_safe) == ["'=1", "'+a", "'-b", "'@c", "ok", None]
    assert column(spark, "string", ["one two  three", "", " a "], T.token_estimate) == [3, 0, 1]
    assert column(spark, "double", [80.0, 72.5], T.weight_label) == ["80 kg", "72.5 kg"]
    assert column(spark, "string", ['```json\n[1]\n```', 'so: {"a": 1} ok', "none"], lambda c: F.to_json(T.lenient_json(c))) == ["[1]", '{"a":1}', None]
    both = column(spark, "string", ["b"], lambda c: T.preamble(F.lit("S"), F.lit("A"), F.lit(""), c))
    assert both == ["[Source: S | Author: A]\n[Section: b]\n\n"]
    parts = column(spark, "string", ["pre\n# One\nbody 1\n## Two\nbody 2"], T.heading_sections)[0]
    assert [tuple(p) for p in parts] == [("", "pre"), ("One", "body 1"), ("Two", "body 2")]
    assert column(spark, "string", ["http://a/b/c/", "http://a/x"], T.slug) == ["c", "x"]
    assert column(spark, "string", ["Jane Doe", "jane", "Jane 2"], T.plausible_author) == [True, False, False]


def test_trend(spark):
    values = [[1.0, 1.0, 1.0, 2.5, 2.5, 2.5], [3.0, 3.0, 3.0, 1.0, 1.0, 1.0], [1.0, 5.0], []]
    assert column(spark, "array<double>", values, lambda c: A.trend(c, 0.5)) == ["ascending", "descending", "stable", "stable"]
    fall = [[0.95] * 3 + [0.60] * 3]
    assert column(spark, "array<double>", fall, lambda c: A.trend(c, 0.07)) == ["descending"] and column(spark, "array<double>", fall, lambda c: A.trend(c, 0.5)) == ["stable"]


def test_outcome(spark):
    sessions = spark.createDataFrame([(1, 10 + i, i // 4 + 1, i % 4 + 1) for i in range(16)], "program_id int, session_id int, week int, day int")
    logs = spark.createDataFrame([(1, 10)], "log_id int, session_id int")
    entries = spark.createDataFrame([(1, 1, 1, 0.0, 0.9, 3, [3, 3, 2]), (2, 1, 2, 1.0, 1.0, 3, [3])], "entry_id int, log_id int, position int, rpe_deviation double, make_rate double, sets int, reps_per_set array<int>")
    (r,) = A.outcomes(sessions, logs, entries).collect()
    assert (r.planned, r.completed, r.adherence_pct, r.avg_rpe_deviation, r.avg_make_rate, r.avg_weekly_reps, r.rpe_trend) == (16, 1, 6.2, 0.5, 0.95, 17.0, "stable")
    (r,) = A.outcomes(sessions, logs.where("false"), entries).collect()
    assert (r.completed, r.adherence_pct, r.avg_rpe_deviation, r.avg_make_rate, r.make_rate_trend) == (0, 0.0, 0.0, 0.0, "stable")


def test_phase_rules(spark):
    cases = [(None, 90.0, 0.85, 0.2, "accumulation", False, "cold_start"), ("realization", 90.0, 0.85, 2.0, "accumulation", False, "realization_rebuild"), ("accumulation", 75.0, 0.80, 0.5, "intensification", True, "advanced"), ("accumulation", 90.0, 0.85, 2.0, "accumulation", False, "rpe_held"), ("accumulation", 50.0, 0.60, 0.3, "accumulation", False, "repeated")]
    df = spark.createDataFrame([c[:4] for c in cases], "p string, a double, m double, e double")
    got = [tuple(r[0]) for r in df.select(P.next_phase(*map(F.col, "pame"))).collect()]
    assert got == [c[4:] for c in cases]
    plan = spark.createDataFrame([("accumulation", 6, "beginner"), ("intensification", 5, "elite"), ("general_prep", 3, "advanced")], "phase string, duration int, level string")
    rows = {(r.phase, r.week_number): r for r in P.weekly_targets(plan).collect()}
    assert [rows["accumulation", i].intensity_floor for i in range(1, 7)] == [64, 66, 68, 66, 68, 61] and rows["accumulation", 6].is_deload
    assert rows["intensification", 5].intensity_ceiling == 93 and not rows["intensification", 5].is_deload
    assert [rows["general_prep", i].intensity_floor for i in (1, 2, 3)] == [70, 72, 65] and rows["general_prep", 3].is_deload


def exercises(spark, rows):
    names = "row_id int, session_id int, athlete_id int, exercise_name string, exercise_order int, sets int, reps int, intensity_pct double, intensity_reference string, rest_seconds int, rpe_target double"
    return spark.createDataFrame([(i, 1, 1, *r) for i, r in enumerate(rows)], names)


def test_validation(spark):
    good = exercises(spark, [("Snatch", 1, 4, 4, 75.0, "snatch", 120, 8.0)])
    sessions = spark.createDataFrame([(1, 1, 1, 1, 80, 30, 70.0, 80.0)], "session_id int, program_id int, week int, day int, budget int, available_minutes int, week_floor double, week_ceiling double")
    athletes = spark.createDataFrame([(1, ["Bad Lift"], [], [])], "athlete_id int, avoid array<string>, strength_limiters array<string>, technical_faults array<string>")
    laws = spark.createDataFrame([("r", 9, True)], "rule_id string, max_exercises int, lifts_first boolean")
    assert L.all_checks(good, sessions, athletes, laws, ["x"]).count() == 0
    bad = exercises(spark, [("Bad Lift", 1, 0, 5, 121.0, "back_squat", None, 6.0), ("Snatch", 1, 40, 3, 91.0, "snatch", 60, 7.0), ("Clean", None, 2, 2, 66.0, "clean", 60, None)])
    found = {(r.check, r.severity) for r in L.all_checks(bad, sessions, athletes, laws).collect()}
    assert found >= {("sets", "error"), ("intensity_range", "error"), ("order", "error"), ("duplicate_order", "error"), ("zone_volume", "error"), ("weekly_budget", "warning"), ("above_ceiling", "error"), ("supramaximal", "warning"), ("below_floor", "warning"), ("reps_per_set", "error"), ("avoided", "error"), ("lifts_first", "warning"), ("duration", "warning"), ("low_effort_target", "warning")}


def test_sections_and_chunks(spark):
    text = "intro\n# One\nbody one\nChapter 2 Title\nbody two\n1.1 Part\n\nbody three"
    assert S.split_sections(text) == [("", "", "intro"), ("", "# One", "body one"), ("Chapter 2 Title", "Chapter 2 Title", "body two"), ("Chapter 2 Title", "1.1 Part", "body three")]
    assert S.split_sections("plain") == [("", "", "plain")] and S.split_blocks("a\nWeek 1 x\nb") == [("", "a\n"), ("Week 1 x", "\nb")]
    paragraphs = "\n\n".join(f"Sentence {i} has some words in it. Another one follows here." for i in range(30))
    packed = S.pack_paragraphs(paragraphs, 60, 10)
    assert len(packed) > 3 and all(S.estimate(p) <= 90 for p in packed) and packed[1].startswith("Another one follows here.")
    assert S.breaks_pattern("do 5x3 @", "75% now") and not S.breaks_pattern("text", "more")
    kinds = ["a|b|c\nd|e|f\ng|h|i", "Monday:\n  Snatch 5x3\n  Squat 3 sets\n", "Power Snatch\nA fast lift.", "should not exceed 5. always use 10%. at least 3 " + "word " * 110, "never go. always use. at least 3.", "plain text", "at least 3 " + "word " * 60]
    got = column(spark, "string", kinds, S.classify)
    assert [(g.type, float(g.confidence)) for g in got] == [("table", 0.85), ("program_template", 0.8), ("exercise_description", 0.7), ("mixed", 0.75), ("principle", 0.7), ("prose", 0.6), ("prose", 0.55)]
    assert column(spark, "string", ["a permission to err"], lambda c: Tagger(spark, {"miss": ["fault"], "zzz": ["z"]}).topics(c)) == [["fault"]]
    bad = column(spark, "string", ["lower " * 5 + "5x3 @ 70% 5x3 @ 70% 5x3 @ 70%"], lambda c: S.validated(T.token_estimate(c), F.array().cast("array<string>"), c))[0]
    assert bad.issues == ["too_short", "no_topics", "rep_schemes", "starts_lowercase"] and bad.severity == "warning" and not bad.is_valid
    got = column(spark, "string", ["Hang Power Snatch"], lambda c: S.exercise_of(c, F.lit("Fast. Then more.")))[0]
    assert tuple(got) == ("Hang Power Snatch", "snatch", "variation", "Fast")


def test_hooks(spark):
    df = spark.createDataFrame([(1, "x" * 150, "prose", 0.55), (2, "y" * 150, "prose", 0.8), (3, "z" * 120, "prose", 0.5)], "id int, content string, type string, confidence double")

    def ask(text, title):
        if text[0] == "z":
            raise ValueError
        return "principle", 0.9

    assert {r.id: (r.type, r.confidence) for r in S.adjudicated(df, "content", ask).collect()} == {1: ("principle", 0.9), 2: ("prose", 0.8), 3: ("prose", 0.5)}
    docs = spark.createDataFrame([(1, "w" * 16000)], "id int, content string")
    rows = S.extracted(docs, "content", lambda w: '[{"name": "n%d"}, {"name": "all"}, {"x": 1}]' % len(w), "name string")
    assert sorted(r.name for r in rows.collect()) == ["all", "n1000", "n8000"]
    found = spark.createDataFrame([(1, 0, [(1,), (2,)]), (1, 1, [(2,), (3,)]), (1, 2, []), (1, 3, []), (1, 4, [(9,)])], "id int, window_no int, weeks array<struct<week:int>>")
    assert [w.week for w in S.merged_programs(found).first().weeks] == [1, 2, 3]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, "keep", None), (2, "", [1]), (None, "n", [])], "id int, purpose string, faults array<int>")
    new = spark.createDataFrame([(1, "x", [7]), (2, "y", [8]), (3, "z", [9]), (None, "m", [5])], "id int, purpose string, faults array<int>")
    out = M.upsert(old, new, ["id"], {"purpose": M.curated, "faults": M.curated_list})
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "keep", [7]), (2, "y", [1]), (3, "z", [9]), (None, "n", []), (None, "m", [5])], key=str)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, k string")
    assert sorted(r.id for r in M.insert_ignore(rows.where("false"), rows, ["k"], ["id"]).collect()) == [1, 3, 4]
    assert sorted(r.id for r in M.insert_ignore(rows.where("false"), rows, ["k"], ["id"], null_safe=True).collect()) == [1, 3]
    sources = spark.createDataFrame([(1, "T", "A", "http://x/one"), (2, "U", None, None)], "id int, title string, author string, url string")
    asked = spark.createDataFrame([("Other", "A", "http://x/one"), ("T", "A", "http://x/two"), ("U", None, "http://x/3")], "title string, author string, url string")
    got = {r.url: (r.title, r.source_id) for r in M.source_titles(sources, asked).collect()}
    assert got == {"http://x/one": ("T", 1), "http://x/two": ("T [two]", None), "http://x/3": ("U", 2)}
    M.write_csv(spark.createDataFrame([("=1", None, 2)], "a string, b string, c int"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().splitlines() == ["a,b,c", "'=1,,2"]


def test_retrieval(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], "t" if i % 2 else "u", ["a"] if i % 3 else None, None, "high", True) for i in range(12)], "vec_id long, embedding array<float>, chunk_type string, topics array<string>, athlete_level string, information_density string, contains_specific_numbers boolean")
    where = V.metadata_filter(chunk_types=["t"], topics=["a"], level="beginner", min_density="medium", require_numbers=True)
    got = V.cosine_topk(vectors, [2.0, 1.0], k=3, where=where, floor=0.5).collect()
    assert [r.vec_id for r in got] == [5, 11, 1] and got[0].similarity > 0.999
    assert V.cosine_topk(vectors, [2.0, 1.0], k=3, where=where, floor=1.1).count() == 0
    names = spark.createDataFrame([("Snatch",), ("Power Snatch",), ("Squat",)], "name string")
    rows = spark.createDataFrame([("snatch",), ("Snatch Pull",), ("",)], "exercise_name string")
    assert {r.exercise_name: r.suggestions for r in V.suggestions(rows, names).collect()} == {"Snatch Pull": ["Snatch"], "": []}


def test_html_and_files(spark, tmp_path):
    page = "<html><head><script>var t='</p>';</script></head><body><nav>menu</nav><main><h1>Title</h1><p>One <b>two<p>three<br>four</main><footer>f</footer></body></html>"
    assert files.main_text(page) == "Title\n\nOne two\n\nthree\nfour"
    assert files.main_text("<p>a</p><p>b") == "a\n\nb" and files.main_text(None) == ""
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("1.xhtml", "<body><p>Chapter one</p></body>")
        f.writestr("2.xhtml", "<body></body>")
    (tmp_path / "b.epub").write_bytes(z.getvalue())
    (tmp_path / "a.html").write_text(page)
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    pdf = files.with_fallback([lambda c: 1 / 0, lambda c: ["short"], lambda c: ["p" * 120, " ", "q"]])
    got = {(r.path.rsplit("/")[-1], r.page): r.text for r in files.extract(spark, str(tmp_path), pdf).collect()}
    assert got == {("a.html", 0): "Title\n\nOne two\n\nthree\nfour", ("b.epub", 0): "Chapter one", ("c.txt", 0): "plain", ("d.pdf", 0): "p" * 120, ("d.pdf", 1): "q"}
    assert column(spark, "string", ["=== Page 1 ===\na\n=== Page 2 ===\nb", "all", "=== Page 1 ===x"], lambda c: files.split_page_reply(c, 2)) == [["a", "b"], ["all", ""], ["x", ""]]
    (tmp_path / "seed").mkdir()
    (tmp_path / "seed/s.json").write_text('{"target_table": "t", "records": [{"a": 1}, {"a": 2}]}')
    assert [r.a for r in files.json_seeds(spark, str(tmp_path / "seed"), {"t": "a int"})["t"].orderBy("a").collect()] == [1, 2]


def fetch(url):
    return 200, f"page {url.rpartition('=')[2]}"


def test_web(spark):
    web.register(spark)
    rows = spark.read.format("barloom_crawl").options(pages="3", pagesPerTask="2", step="20", fetch="tests.test_units:fetch").load("http://x/c?id=1").collect()
    assert sorted((r.position, r.html) for r in rows) == [(0, "page 0"), (1, "page 20"), (2, "page 40")]
    assert column(spark, "int", [200, 403, 404, 429, 500], web.retry_class) == ["ok", "transient", "permanent", "transient", "transient"]
    assert column(spark, "string", ["start=5 start=20", "x"], lambda c: web.has_next_page(c, F.lit(10))) == [True, False]


def test_stream_is_idempotent(spark, tmp_path):
    rows = [(i, f"text {i % 5}", f"c {i}") for i in range(12)] + [(99, "  ", "x")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "position int, raw_content string, content string")
    df.coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = I.ingest_stream(stream, out, str(tmp_path / "cp"), str(tmp_path / "ledger"), I.hash_embedding(8)).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    df.coalesce(1).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 5 and len(spark.read.parquet(out).first().embedding) == 8


def test_stream_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = I.tumbling(stream, "ts", "1 day", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.event_type, r.window_start)
    got, want = ({key(r): r.n for r in d.collect()} for d in (spark.table("w"), I.tumbling(events, "ts", "1 day", "event_type")))
    assert got == want


def test_warnings_add_up_in_order_of_logs(spark):
    rates = {"forward": [0.08, 0.12, 0.11, 0.47], "back": [0.47, 0.11, 0.12, 0.08]}  # 19.5 percent, and a sum that depends on the order
    logs = spark.range(4).select(F.col("id").alias("log_id"), F.lit(1).alias("athlete_id"), F.lit("2024-01-30").cast("date").alias("log_date"), *[F.lit(3).alias(c) for c in ("overall_rpe", "sleep_quality", "stress_level")])
    entries = spark.createDataFrame([(i, x, None, None, m) for x, own in rates.items() for i, m in enumerate(own)], "log_id long, exercise string, rpe double, rpe_deviation double, make_rate double")
    for order in (F.col("log_id"), F.desc("log_id"), F.col("make_rate")):
        for parts in (1, 3):
            found = A.warning_rows(logs, entries.repartition(parts, "log_id").sortWithinPartitions(order), F.lit("2024-01-31").cast("date"))
            assert sorted(map(tuple, found.collect())) == [(1, "low_make_rate", "back", 19.0), (1, "low_make_rate", "forward", 20.0)]


def test_batches_of_long_texts_are_bounded(spark):
    import pyarrow as pa

    texts = ["", None, "x" * 400_000, "y" * 3_000_000, *["z" * 300_000] * 9, ""]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    parts = list(S.by_bytes(batch, 1))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist() and len(parts) >= 4
    longest = lambda b: sum(len(t or "") for t in b.column(1).to_pylist()) - max(len(t or "") for t in b.column(1).to_pylist())
    assert max(map(longest, parts)) <= S.PIECE_BYTES
    assert [len(b) for b in S.by_bytes(batch.slice(0, 0), 1)] == [0]

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

    from barloom.session import ship

    ship(spark)
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("w"), 100_000).alias("t"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 10_000_000


def test_plans_are_made_once(spark):
    from barloom.queries import QUERIES

    df = QUERIES["athlete_plans"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderpriority") and len([x for x in plan.splitlines() if "Relation [" in x and "o_custkey" in x]) == 1
