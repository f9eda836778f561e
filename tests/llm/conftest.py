import hashlib
import math

import pytest

LONG = " ".join(f"word{i % 977} {'x' * (i % 9)}" for i in range(8_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, sig int, `a b` string"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) with further columns whose names clash with those of operators."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", 1, "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def make(spark):
    return lambda rows: docs(spark, rows)


def copies(rows, seed="mix-1"):
    """(doc_id, source, copy) of the Poisson mix of rows (doc_id, text, source) at the default targets, drawn one by one."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + max(1, len(t or ""))
    all_, roots = sum(sizes.values()), sum(math.sqrt(v) for v in sizes.values())
    out = []
    for i, _, s in rows:
        rate = math.sqrt(sizes[s]) / roots * all_ / sizes[s]
        parts = max(1, math.ceil(rate / 8))
        total = 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"{seed}|{'null' if i is None else i}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = cdf = math.exp(-rate / parts)
            k = 0
            while u > cdf and k < 48:
                k += 1
                p *= rate / parts / k
                cdf += p
            total += k
        out += [(i, s, c) for c in range(total)]
    return out
