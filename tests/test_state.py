"""Streams with keyed state against tables: restarts, order of arrival, expiry."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from barloom.streaming import ingest as I
from barloom.streaming import state

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def run(spark, df, at):
    writer = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(state.PROVIDER, None)
    q = state.started(writer, spark)
    assert spark.conf.get(state.PROVIDER, None) == before
    q.awaitTermination(300)
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def test_dedup_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    texts = [f"text {i}" for i in range(40)] + ["", " \n", None]
    rows = [(i, rng.choice(texts), f"s{i % 3}") for i in range(150)]
    src, schema = str(tmp_path / "src"), "position long, raw_content string, source string"
    for i in range(3):
        part = spark.createDataFrame(rows[50 * i : 50 * (i + 1)], schema)
        part.coalesce(1).write.mode("append").parquet(src)
        # each start of the query goes on from the checkpoint, and meets contents that earlier runs have seen
        got = run(spark, state.new_chunks_stream(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "out"))
    want = I.new_chunks(spark.createDataFrame(rows, schema), None)
    assert sorted(map(tuple, got.select("position", "content_hash", "source").collect())) == sorted(map(tuple, want.select("position", "content_hash", "source").collect()))


def make_events(seed, n=160):
    rng = random.Random(seed)
    at = [START + DAY * 45 * rng.random() for _ in range(n)]
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), t, rng.choice([None, 0.5, 1.25, 2.0, 3.0]), rng.choice([None, 0.25, 0.5, 0.875])) for t in at]
    return rows + [rows[0], ("a", 1, rows[1][2], 9.0, 0.0), ("c", 1, None, 9.0, 0.0), ("zz", 1, START + DAY * 90, None, None)]


EVENTS = "who string, what int, ts timestamp, effort double, make double"
KEYS = {"who": "string", "what": "int"}


def plain(rows, upto):
    """Starts by looking at every point of time at which an event comes or leaves."""
    out = []
    for key in {r[:2] for r in rows if r[2]}:
        own = [r for r in rows if r[:2] == key and r[2]]
        held = {}
        for p in sorted({r[2] for r in own} | {r[2] + 14 * DAY for r in own}):
            last = [r for r in own if p - 14 * DAY < r[2] <= p]
            for kind, i, bad in (("effort_above_target", 3, lambda m: m > 1.5), ("low_make_rate", 4, lambda m: m < 0.7)):
                x = [r[i] for r in last if r[i] is not None]
                on = len(x) >= 2 and bad(sum(x) / len(x))
                if on and not held.get(kind) and p <= upto:
                    out.append((*map(str, key), kind, p, round(sum(x) / len(x), 9)))
                held[kind] = on
    return sorted(out)


def shown(df, upto):
    return sorted((str(r.who), str(r.what), r.kind, r.started_at, round(r.value, 9)) for r in df.collect() if r.started_at <= upto)


def test_warnings_of_the_last_days(spark, tmp_path):
    rows = make_events(1)
    upto = START + DAY * 80
    want = plain(rows, upto)
    assert len(want) > 10 and len({(w[0], w[1], w[2]) for w in want}) < len(want)  # some begin more than once
    df = spark.createDataFrame(rows, EVENTS)
    assert shown(state.warning_starts_batch(df, KEYS, F.lit(upto)), upto) == want
    df.repartition(3).write.parquet(str(tmp_path / "src"))
    got = run(spark, state.warning_starts(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "src")), KEYS), str(tmp_path / "out"))
    assert shown(got, upto) == want


def test_warnings_over_restarts_and_out_of_order(spark, tmp_path):
    rows = sorted((r for r in make_events(2) if r[2]), key=lambda r: r[2])
    # three parts, each shuffled and up to three days late
    rng, parts = random.Random(5), [[], [], []]
    for r in rows:
        late = r[2] + DAY * 3 * rng.random()
        parts[0 if late < START + DAY * 15 else 1 if late < START + DAY * 30 else 2].append(r)
    src, upto = str(tmp_path / "src"), START + DAY * 80
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        got = run(spark, state.warning_starts(spark.readStream.schema(EVENTS).parquet(src), KEYS, delay="4 days"), str(tmp_path / "out"))
    assert shown(got, upto) == plain(rows, upto)


def test_a_mean_at_the_threshold_is_no_warning(spark):
    starts = state.WarningStarts(["who"], 14, 2, 1.5, 0.7)
    # means of 0.7 and 1.5, whose doubles add up to less and to more
    makes, efforts = [0.7, 0.82, 0.58], [2.95, 1.6, 0.05, 0.2, 2.7]
    for p in itertools.permutations(makes):
        assert starts._conditions([(0, None, m) for m in p])["low_make_rate"] == (False, 0.7)
    for p in itertools.permutations(efforts):
        assert starts._conditions([(0, e, None) for e in p])["effort_above_target"] == (False, 1.5)
    rows = spark.createDataFrame([(who, 1, START, e, m) for who, own in (("a", [(None, m) for m in makes]), ("b", [(e, None) for e in efforts])) for e, m in own], EVENTS)
    assert not state.warning_starts_batch(rows, KEYS, F.lit(START)).collect()
