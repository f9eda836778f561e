"""Operator 11: quality rules under weak supervision.

Rules look at counts of a document and vote "good" or "bad" or abstain.  Nobody says how
reliable a rule is: expectation-maximisation estimates, over the votes of all
documents, the share of good documents and for each rule its accuracy on good and on
bad ones; abstentions say nothing.  A document is kept by its posterior probability of
being good, so one vote of a poor rule rejects nothing and one of a reliable rule may.

The votes of a document are a pattern, and there are at most 3 ** len(RULES) of
them.  Spark counts patterns; the driver gets one row for each pattern that occurs,
and the estimate is the same as over all documents one by one.  Whole texts are
read once; the counts of each document are written once, narrow, for two uses.

Words are runs of bytes other than space, tab, LF, VT, FF and CR; counting is by exact
comparison of words and lines, not of hashes.  Apart from the posterior two fixed rules
always reject (base_failed): under MIN_WORDS words, or over half of the words in repeated
windows of three.

Null texts are empty: no words, base_failed.  Empty texts have no votes.  Repeated rows are
judged alike and count each.  Ties: a posterior of exactly THRESHOLD keeps.  Very long
texts are counted whole, one at a time.  An empty table gives an empty result.  A null doc_id
is a row like any other.  Further columns are not looked at, whatever their names, and
pass through kept() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import ship, staged

MIN_WORDS, REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5
#: Distinct words up to which three word numbers fit one 64-bit number.
DIRECT = 1 << 20
ROUNDS = 60
#: Where the estimate starts: the share of good documents, a rule's accuracy on good ones and on bad ones.  A rule sees one kind of bad document, so the last is low.
START = (0.9, 0.99, 0.3)
#: The start goes on counting like votes of so large a share of all documents, at every size.
WEIGHT = 0.05

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letters", "n_ascii_letters", "n_upper", "n_marks", "n_letter_words"]

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[[ord("!"), ord("?")]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER_OR_MORE = _LETTER.copy()
_LETTER_OR_MORE[128:] = 1
_POINT = np.ones(256, np.uint8)
_POINT[0x80:0xC0] = 0


@dataclass(frozen=True)
class Rule:
    """Votes good below ``good`` and bad above ``bad``, abstains between and where ``of`` is under ``least``.

    The measure is 1000 * top / of, in whole numbers; reverse turns both comparisons round.
    """

    name: str
    top: str
    of: str
    good: int
    bad: int
    least: int = 20
    reverse: bool = False

    def vote(self) -> Column:
        """1 good, -1 bad, 0 none."""
        x, of = 1000 * F.col(self.top), F.col(self.of)
        good, bad = (x < self.good * of, x > self.bad * of) if not self.reverse else (x > self.good * of, x < self.bad * of)
        return F.when(of < self.least, 0).when(bad, -1).when(good, 1).otherwise(0)

    def sql(self) -> str:
        low, high = ("<", ">") if not self.reverse else (">", "<")
        x = f"1000 * {self.top}"
        return f"CASE WHEN {self.of} < {self.least} THEN 0 WHEN {x} {high} {self.bad} * {self.of} THEN -1 WHEN {x} {low} {self.good} * {self.of} THEN 1 ELSE 0 END"


RULES = [
    Rule("symbols", "n_symbols", "n_words", 20, 100),
    Rule("letters", "n_letters", "word_chars", 850, 720, reverse=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, 500, least=4),
    Rule("repeated_words", "n_repeat_words", "n_words", 200, 400),
    Rule("long_words", "word_chars", "n_words", 9000, 13000),
    Rule("short_words", "word_chars", "n_words", 3000, 2200, reverse=True),
    Rule("capitals", "n_upper", "n_ascii_letters", 150, 400),
    Rule("shouts", "n_marks", "n_words", 50, 200),
    Rule("wordless", "n_letter_words", "n_words", 850, 700, reverse=True),
    Rule("few_words", "n_distinct_words", "n_words", 300, 120, reverse=True),
]


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each document."""
    n = len(offsets) - 1
    zero = np.zeros(n, np.int64)
    if not len(data):
        return [zero] * len(COUNTS)
    per_byte = lambda kinds: _between(kinds, offsets)
    starts, ends, at = K.word_spans(data, offsets)
    n_words = np.diff(at)
    space = K.IS_SPACE[data]
    doc = np.repeat(np.arange(n), n_words)
    words = _strings(data[~space], ends - starts)
    codes = _codes(words)
    size = int(codes.max()) + 1 if len(codes) else 1
    distinct = np.bincount(np.unique(doc * size + codes) // size, minlength=n)
    lines, dup = _lines(data, offsets, space)
    letters = np.concatenate([[0], np.cumsum(_LETTER_OR_MORE[data], dtype=np.int64)])
    letter_words = np.bincount(doc[letters[ends] > letters[starts]], minlength=n)
    return [
        n_words, per_byte(np.where(space, 0, _POINT[data])), per_byte(_SYMBOL[data]), dup, _repeated(codes, doc, size, n), lines, distinct,
        per_byte(_LETTER_OR_MORE[data] & _POINT[data]), per_byte(_LETTER[data]), per_byte(_UPPER[data]), per_byte(_MARK[data]), letter_words,
    ]


def _between(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _strings(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _codes(strings: pa.Array) -> np.ndarray:
    """Equal strings, compared whole, have equal numbers."""
    return np.asarray(strings.dictionary_encode().indices).astype(np.int64)


def _lines(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by document."""
    n = len(offsets) - 1
    newline = data == 0x0A
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(newline) + 1]))
    starts = starts[starts < len(data)]
    bounds = np.append(starts, len(data))
    text = np.concatenate([[0], np.cumsum(~newline, dtype=np.int64)])
    filled = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    full = filled[bounds[1:]] > filled[bounds[:-1]]
    codes = _codes(_strings(data[~newline], np.diff(text[bounds])))[full]
    doc = (np.searchsorted(offsets, starts, "right") - 1)[full]
    size = int(codes.max()) + 1 if len(codes) else 1
    lines = np.bincount(doc, minlength=n)
    return lines, lines - np.bincount(np.unique(doc * size + codes) // size, minlength=n)


def _repeated(codes: np.ndarray, doc: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words in windows of three that a document has twice or more."""
    if len(codes) < 4:
        return np.zeros(n, np.int64)
    if size < DIRECT:
        three = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:
        three = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)[1] * size + codes[2:]
    inside = doc[:-2] == doc[2:]
    _, three = np.unique(three[inside], return_inverse=True)
    _, back, times = np.unique(doc[:-2][inside] * (len(three) + 1) + three, return_inverse=True, return_counts=True)
    found = np.zeros(len(codes), bool)
    found[:-2][inside] = times[back] > 1
    covered = found.copy()
    covered[1:] |= found[:-1]
    covered[2:] |= found[:-2]
    return np.bincount(doc[covered], minlength=n)


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the COUNTS of every row."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for a, b in K.chunks(offsets):
                got = counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, got)], names=["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, schema)


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def votes() -> Column:
    """All votes of a row, in the order of RULES."""
    return F.array(*[r.vote().cast("byte") for r in RULES])


@dataclass
class Accuracies:
    """What was estimated: the share of good documents, and each rule's accuracy where it votes on good and on bad ones."""

    good: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-odds of the prior, of a good vote and of a bad vote by rule; a rule no better than chance weighs nothing."""
        better = self.on_good + self.on_bad > 1
        return (
            float(np.log(self.good / (1 - self.good))),
            np.where(better, np.log(self.on_good / (1 - self.on_bad)), 0.0),
            np.where(better, np.log((1 - self.on_good) / self.on_bad), 0.0),
        )

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        prior, up, down = self.weights()
        return 1 / (1 + np.exp(-(prior + (patterns > 0) @ up + (patterns < 0) @ down)))


def estimated(patterns: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over vote patterns that occur n times each."""
    rules, own = patterns.shape[1], WEIGHT * max(n.sum(), 1.0)
    now = Accuracies(START[0], np.full(rules, START[1]), np.full(rules, START[2]))
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    for _ in range(rounds):
        p = now.posterior(patterns)
        good, bad = p * n, (1 - p) * n
        now = Accuracies(
            (good.sum() + own * START[0]) / (n.sum() + own),
            (good @ up + own * START[1]) / (good @ (up + down) + own),
            (bad @ down + own * START[2]) / (bad @ (up + down) + own),
        )
    return now


def learned(rows: DataFrame) -> Accuracies:
    """From rows with COUNTS; patterns are counted by Spark, and one row a pattern comes to the driver."""
    found = sorted((tuple(r.votes), r.n) for r in rows.groupBy(votes().alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = np.array([p for p, _ in found], np.int8).reshape(-1, len(RULES))
    return estimated(patterns, np.array([n for _, n in found], float))


def posterior(model: Accuracies) -> Column:
    prior, up, down = model.weights()
    total = F.lit(prior)
    for r, u, d in zip(RULES, up, down):
        v = r.vote()
        total = total + F.when(v > 0, float(u)).when(v < 0, float(d)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    rows = staged(counted(docs, text, doc_id), "rules-counts")
    good = posterior(learned(rows))
    return rows.select("doc_id", *COUNTS[:5], failed().alias("base_failed"), (~failed() & (good >= threshold)).alias("kept"), good.alias("posterior"))


def kept(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are not shuffled."""
    at = docs.columns.index(text)
    model = learned(staged(counted(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))), "rules-counts"))
    prior, up, down = model.weights()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(at))
            for a, b in K.chunks(offsets):
                c = dict(zip(COUNTS, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
                total = np.full(b - a, prior)
                for r, u, d in zip(RULES, up, down):
                    x, of = 1000 * c[r.top], c[r.of]
                    high, low = (x > r.bad * of, x < r.good * of) if not r.reverse else (x < r.bad * of, x > r.good * of)
                    total += np.where(of < r.least, 0.0, np.where(high, d, np.where(low, u, 0.0)))
                fails = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                yield batch.slice(a, b - a).filter(pa.array(~fails & (1 / (1 + np.exp(-total)) >= threshold)))

    return docs.mapInArrow(work, docs.schema)
