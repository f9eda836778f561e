"""Language model, quality classifier, WARC, embeddings and near-duplicates."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bagminhash, embeddings, lm, quality, warc
from barloom.llm._io import fresh_path
from barloom.llm.components import components

from .conftest import LONG

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(t):
    return SPACE.findall((t or "").encode().translate(LOW))


def texts(seed=1, n=150):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    return [(i, " ".join(vocab[int(rng.paretovariate(0.6)) % 200] for _ in range(rng.randint(0, 120)))) for i in range(n)]


def test_lm_base_is_exact_and_score_is_better(make):
    rows = texts() + [(900, None), (901, ""), (902, " \t"), (903, LONG), (None, "a b")]
    got = {r.doc_id: r for r in lm.score(make(rows)).collect()}
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    mine = base = 0.0
    for i, t in rows:
        toks = [*words(t), None]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(toks), sum(c[w] > 0 for w in toks), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score <= 0 and math.isfinite(r.score)
        mine, base = mine + r.score, base + want
    assert mine > base
    assert lm.score(make([])).count() == 0


def test_lm_score_is_the_smoothed_bigram_model(make):
    rows = texts(3) + [(900, None), (901, "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, g = collections.Counter(), collections.defaultdict(collections.Counter)
    seqs = {i: [*words(t), "end"] for i, t in rows}
    for i, toks in seqs.items():
        if not held(i):
            c.update(toks)
            for h, w in zip(["end", *toks], toks):
                g[h][w] += 1
    n, v = sum(c.values()), len(c)
    value = lambda x: float(lm.VALUES[int(lm.quantised(np.array(x)))])
    hot = {w for w, _ in c.most_common(lm.HOT)}  # all words here: their masses are exact sums
    assert len(c) <= lm.HOT and hot
    diffs = []
    for r in lm.score(make(rows)).collect():
        want = 0.0
        toks = seqs[r.doc_id]
        for h, w in zip(["end", *toks], toks):
            s, b = sum(map(value, g[h].values())), max(len(g[h]), 1)
            want += math.log10(min(1.0, (min(value(g[h][w]), s) + b * (value(c[w]) + 1) / (n + v + 1)) / (s + b)))
        diffs.append((r.score - want) / len(toks))
    # a filter errs upwards, for a few keys in a hundred
    assert np.median(np.abs(diffs)) < 0.02 and np.mean(diffs) < 0.02 and np.mean(np.abs(diffs) < 1e-9) > 0.1


def test_lm_shards_give_the_rows_and_scores_of_one(make, monkeypatch):
    rows = texts() + [(3, "a b"), (900, None), (None, "a b")]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(lm.score(make(rows)).collect(), key=key)
    fit, shards = lm.fit, []
    monkeypatch.setattr(lm, "fit", lambda docs: shards.append(fit(docs)) or shards[-1])
    monkeypatch.setattr(lm, "SHARD_BYTES", 600)
    got = sorted(lm.score(make(rows)).collect(), key=key)
    assert len(shards[0]["shards"]) > 1 and len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g.base_score == pytest.approx(w.base_score) and g.score == pytest.approx(w.score)


def test_lm_word_shards_give_the_rows_and_scores_of_one(make, monkeypatch):
    rows = texts() + [(900, None), (901, ""), (None, "a b")]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(lm.score(make(rows)).collect(), key=key)
    monkeypatch.setattr(lm, "UNIGRAM_BYTES", 400)
    monkeypatch.setattr(lm, "SHARD_BYTES", 1200)
    got = sorted(lm.score(make(rows)).collect(), key=key)
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g.base_score == pytest.approx(w.base_score) and g.score == pytest.approx(w.score)


def test_lm_filter_holds_bigrams_counted_once():
    from barloom.llm import _kernels as K

    h, w, hot = np.repeat(K.mix(np.arange(40, dtype=np.uint64)), 5), K.mix(np.arange(200, dtype=np.uint64) + np.uint64(999)), np.zeros(0, np.uint64)
    code = lm.code_of(h, w)
    again = np.arange(200) % 5 == 0  # one successor of each context is counted twice
    batch = lm.packed_pairs(np.concatenate([h, h[again]]), np.concatenate([code, code[again]]), hot, 1)
    bits, _ = lm.merged(list(zip(*(batch.column(i).to_pylist() for i in range(1, 5)))), hot)
    f, zeros = lm.Filter(1, [(0, len(bits))]), np.zeros(200, int)
    f.put(0, bits)
    level = f.count(K.pair(h, code), zeros)
    assert (level >= np.where(again, 2, 1)).all() and (level == np.where(again, 2, 1)).mean() > 0.95
    assert (f.count(lm.kept_key(h), zeros) >= lm.quantised(np.array(6))).all() and (f.count(lm.backoff_key(h), zeros) >= lm.quantised(np.array(5))).all()


def test_lm_filter_never_loses_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    levels = rng.integers(1, 9, 3000)
    bits = lm.segment(keys, levels).tobytes()
    f = lm.Filter(4, [(2, len(bits))])
    f.put(2, bits)
    found = f.count(keys, np.full(3000, 2))
    assert (found >= levels).all() and (found == levels).mean() > 0.95
    other = rng.integers(0, 2**63, 3000).astype(np.uint64)
    assert (f.count(other, np.full(3000, 2)) > 0).mean() < 0.04 and (f.count(other, np.zeros(3000, int)) == 0).all()


def test_quality_held_out_accuracy(spark, make):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        good = rng.random() < 0.8
        body = " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90)))
        rows.append((i, body.capitalize() + "." if good else " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in body.split())))
        marks.append((i, int(good)))
    rows += [(2000, None), (2001, ""), (2002, LONG), (None, "a b c")]
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(make(rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    test = [(got[i], y) for i, y in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in test) and sum(r.predicted == y for r, y in test) / len(test) > 0.97
    kept = quality.accepted(make(rows), labels)
    assert kept.columns == make(rows).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in quality.score(make(rows[:9]), labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.score(make([]), labels).count() == 0


def test_quality_against_brute_force(spark, make):
    """The same model from all rows at once: statistics, ridge by least squares, isotonic values by minimax."""
    rng = random.Random(8)
    rows, marks = [], {}
    for i in range(400):
        good = rng.random() < 0.6
        body = [("".join(rng.choice("aeiounst") for _ in range(rng.randint(2, 8)))) + ("" if good or rng.random() < 0.7 else "#") for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(body)))
        marks[i] = int(good if rng.random() < 0.9 else not good)
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(make(rows), labels).collect()}

    import pyarrow as pa

    from barloom.llm import _kernels as K

    data, offsets = K.text_buffer(pa.array([t for _, t in rows]))
    x = quality.statistics(data, offsets).astype(np.float32).astype(float)
    z = quality.fourier(np.clip((x - x.mean(0)) / np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-8)), -4, 4))
    train = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows])
    y = np.array([marks[i] for i, _ in rows], float)
    fold = np.array([r.f for r in spark.range(len(rows)).select(F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS)).cast("int").alias("f")).collect()])

    def ridge(own):
        w = np.sqrt(quality.RIDGE * own.sum() / quality.WIDTH)
        return np.linalg.lstsq(np.vstack([z[own], w * np.eye(z.shape[1])]), np.concatenate([y[own], np.zeros(z.shape[1])]), rcond=None)[0]

    raw = z @ ridge(train)
    out_of_fold = np.array([z[i] @ ridge(train & (fold != fold[i])) for i in range(len(rows))])
    at = np.clip(((out_of_fold + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at[train]))
    mean = np.array([y[train & (at == b)].mean() for b in bins])
    count = np.array([(train & (at == b)).sum() for b in bins])
    place = np.array([out_of_fold[train & (at == b)].mean() for b in bins])
    avg = lambda i, j: (mean[i : j + 1] * count[i : j + 1]).sum() / count[i : j + 1].sum()
    iso = np.array([max(min(avg(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))])
    knots = []
    for u in dict.fromkeys(np.round(iso, 10)):
        own = np.abs(iso - u) < 1e-9
        knots.append((np.average(place[own], weights=count[own]), u))
    want = np.interp(raw, [k for k, _ in knots], [u for _, u in knots])
    assert max(abs(got[i] - w) for (i, _), w in zip(rows, want)) < 1e-5


def test_warc_record_alone_and_very_long(spark):
    body = "".join(chr(97 + (i * i) % 26) for i in range(1000)) * 40_000  # 40 MB: longer than an archive's aim
    df = spark.createDataFrame([(1, "u", "<p>one " * 40), (2, "u", body), (3, "u", body), (4, "u", "<p>four " * 40)], "page_id long, url string, html string")
    path = fresh_path(spark, "test-warc")
    manifest = warc.write(warc.typed(df), path)
    got = {r.page_id: r for r in warc.read(manifest, path).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("response", None, 280), 2: ("response", None, len(body)), 3: ("revisit", 2, len(body)), 4: ("response", None, 320)}
    seen = set()
    for m in manifest.collect():
        raw = open(m.path, "rb").read()
        assert len(m.offsets) == m.records
        for offset in m.offsets:
            one = warc.record_at(raw, offset)
            assert one.startswith(b"WARC/1.1\r\n")
            seen.add(warc.page_of(re.search(rb"WARC-Record-ID: (\S+)", one).group(1).decode()))
    assert seen == {1, 2, 3, 4}


def test_warc_round_trip(spark):
    rng = random.Random(2)
    long = "<p>" + "x" * 200_000
    rows = [(i, f"http://a/{i}", "<html>" + "".join(rng.choice("abc ") for _ in range(rng.choice([5, 300])))) for i in range(80)]
    rows += [(100 + i, "http://b c\n/", long if i % 2 else "short") for i in range(6)] + [(200, None, None), (201, "u", ""), (None, "u", long), (-5, "u", "é" * 90), (300, "u", "é" * 90)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = fresh_path(spark, "test-warc")
    manifest = warc.write(warc.typed(df), path)
    got = warc.read(manifest, path).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    import hashlib

    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and first[h] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else b))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    for r in manifest.collect():
        raw = open(r.path, "rb").read()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and len(raw) == r.bytes
    assert warc.read(warc.write(warc.typed(df.where("page_id = 12345678")), path), path).count() == 0


def brute(rows, threshold=0.93):
    x = [None if v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v) for _, v, _ in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    return links


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "PIECE", 64)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(700):
        c = centres[int(rng.integers(40)) if i % 3 else 0]
        rows.append((i, (c + rng.standard_normal(16) * rng.choice([0.02, 0.3])).astype(np.float32).tolist(), int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [1.0], 0), (2006, [2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n_rows int")
    links = brute(rows)
    comp = list(range(len(rows)))
    for i in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        stack = [i]
        while stack:
            k = stack.pop()
            for j in links[k]:
                if comp[j] > comp[i]:
                    comp[j] = comp[i]
                    stack.append(j)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[r[0]].n_links for r in rows)
    assert found >= 0.98 * sum(map(len, links)) and all(got[r[0]].n_links <= len(x) for r, x in zip(rows, links))
    for (i, _, _), c in zip(rows, comp):
        assert got[i].component_id == rows[c][0] and got[i].kept == (rows[c][0] == i)
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_recall_of_the_forest_as_it_is(spark):
    """Default parameters on one label of 1,200 vectors, well over a leaf: pairs just over the threshold."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((600, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    c = rng.uniform(0.931, 0.95, 600)[:, None]
    b = rng.standard_normal((600, 24))
    b -= (a * b).sum(1)[:, None] * a
    x = np.vstack([a, a * c + b / np.linalg.norm(b, axis=1)[:, None] * np.sqrt(1 - c * c)])
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert len(x) > 4 * embeddings.LEAF and sum(got.values()) >= 0.95 * hit.sum() and all(got[i] <= k for i, k in enumerate(hit.sum(1)))


def test_embeddings_of_extreme_size(spark):
    one = [1.0, 2.0, -3.0]
    rows = [(1, [v * 1e200 for v in one], 0), (2, [v * 1e-200 for v in one], 0), (3, one, 0), (4, [3.0, -1.0, 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def jaccard(a, b):
    x, y = (collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


@pytest.mark.parametrize("block", [8, 1024])
def test_near_duplicates_against_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rng = random.Random(11)
    base = [t for _, t in texts(4, 40) if len(t.split()) > 40]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):  # a hot group of near copies, and chains of others
        w = base[0 if i % 2 else i % len(base)].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " "), (503, LONG), (504, LONG + " tail"), (505, "a b"), (506, "A  b"), (None, base[1]), (507, "rep eat " * 60), (508, "rep eat " * 55), (100, base[2])]
    w = [words(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if w[i] and w[j]:
                s = jaccard(w[i], w[j])
                if s >= 0.8:
                    group[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[find(k)].append(i)
    want = sorted(((rows[k][0], min((i for i in classes[find(k)] if i is not None), default=None), len(classes[find(k)])) for k in range(len(rows))), key=str)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in bagminhash.classes(make(rows)).collect()), key=str)
    assert got == want


def test_near_duplicates_of_nothing(make):
    assert bagminhash.classes(make([])).count() == 0


def test_near_duplicates_keep_rows_by_id_and_text(make):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, one), (5, one + " end"), (5, other), (8, other + " end"), (5, None)]
    kept = bagminhash.representatives(make(rows).withColumn("content", F.lit(1)).withColumn("__id", F.lit(2)))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, one), (5, other), (5, None)], key=str)
    assert kept.columns[-2:] == ["content", "__id"]


def test_isolated_pairs_just_above_the_threshold_are_found(make):
    rng = random.Random(21)
    rows, above, below = [], [], []
    for k in range(260):
        a = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 200))]
        b = list(a)
        for _ in range(max(1, round(len(a) * rng.uniform(0.015, 0.026)))):
            b[rng.randrange(len(b))] = f"new{rng.random()}"
        s = jaccard([w.encode() for w in a], [w.encode() for w in b])
        if 0.8 <= s < 0.86 or 0.74 <= s < 0.8:
            (above if s >= 0.8 else below).append(k)
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    size = {r.doc_id: r.class_size for r in bagminhash.classes(make(rows)).collect()}
    assert len(above) > 40 and len(below) > 20
    assert [k for k in above if size[2 * k] != 2] == [] and [k for k in below if size[2 * k] != 1] == []


def test_signatures_estimate_weighted_jaccard():
    import pyarrow as pa

    from barloom.llm import _kernels as K

    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(400)]
    b = list(a)
    for _ in range(12):
        b[rng.randrange(400)] = "z"
    data, offsets = K.text_buffer(pa.array([" ".join(a), " ".join(b)]))
    doc, name, count, _, _ = bagminhash.multisets(data, offsets)
    sig = bagminhash.signatures(doc, name, count, 2)
    true = jaccard(words(" ".join(a)), words(" ".join(b)))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


@pytest.mark.parametrize("together", [7, 100_000])
def test_components(spark, monkeypatch, together):
    monkeypatch.setattr("barloom.llm.components.TOGETHER", together)
    rng = random.Random(1)
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(80)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
