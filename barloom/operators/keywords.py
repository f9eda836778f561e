"""Keyword tagging with an Aho-Corasick automaton: all keywords of a vocabulary in one pass over the bytes of a text.

The automaton is a table of transitions over classes of UTF-8 bytes.  It is built once on the driver from a vocabulary
whose size is checked, broadcast, and run over Arrow buffers: texts are cut into lanes that overlap by the longest
keyword, and all lanes take a step at once, so the time does not depend on how many keywords there are.  A larger
vocabulary is split into automata of PART_BYTES keyword bytes each, of which a pass over the texts takes up to A_PASS.

Null texts and null keywords match nothing, an empty keyword matches every text.  Upper case counts as lower case
on both sides.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ship

#: Bytes of keywords in one automaton; a state has at most 256 transitions of 4 bytes, so it takes 64 MB at most.
PART_BYTES = 60_000
#: Automata that one pass over the texts takes.
A_PASS = 4
#: Bytes of a lane, and of the texts of a step's lanes together.
LANE, BLOCK_BYTES = 1024, 4 << 20


class Automaton:
    """Finds which topics have a keyword in a text.  words: (keyword, topic), keywords in lower case."""

    def __init__(self, words: Sequence[tuple[str, str]]):
        self.names = sorted({t for _, t in words})
        number = {t: i for i, t in enumerate(self.names)}
        own: dict[bytes, set[int]] = {}
        for keyword, topic in words:
            own.setdefault(keyword.encode(), set()).add(number[topic])
        self.always = sorted(own.pop(b"", ()))
        self.longest = max(map(len, own), default=1)
        used = sorted(set(b"".join(own)))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # the trie, then transitions along suffixes, level by level
        below: list[dict[int, int]] = [{}]
        topics: list[set[int]] = [set()]
        for word, ids in own.items():
            at = 0
            for c in self.classes[np.frombuffer(word, np.uint8)].tolist():
                if c not in below[at]:
                    below[at][c] = len(below)
                    below.append({})
                    topics.append(set())
                at = below[at][c]
            topics[at] |= ids
        self.table = np.zeros((len(below), width), np.int32)
        suffix = [0] * len(below)
        for c, to in below[0].items():
            self.table[0, c] = to
        queue = deque(below[0].values())
        while queue:
            at = queue.popleft()
            topics[at] |= topics[suffix[at]]
            self.table[at] = self.table[suffix[at]]
            for c, to in below[at].items():
                suffix[to] = int(self.table[suffix[at], c])
                self.table[at, c] = to
                queue.append(to)
        counts = np.array([len(t) for t in topics])
        self.found = counts > 0
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.topics = np.array([i for t in topics for i in sorted(t)], np.int64)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, state) of all keywords that end somewhere, each pair once; data: bytes, offsets: those of the documents."""
        size = np.diff(offsets)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.maximum(part * LANE - (self.longest - 1), 0)
        length = np.minimum((part + 1) * LANE, size[doc]) - start
        order = np.argsort(-length, kind="stable")
        doc, at, length = doc[order], (offsets[doc] + start)[order], length[order]
        kinds = self.classes[data]
        state, states, out = np.zeros(len(doc), np.int32), len(self.found), []
        flat, width = self.table.ravel(), self.table.shape[1]
        for j in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -j, "left"))
            now = flat[state[:live] * width + kinds[at[:live] + j]]
            state[:live] = now
            ended = np.flatnonzero(self.found[now])
            if len(ended):
                out.append(doc[ended] * states + now[ended])
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pairs // states, pairs % states

    def tag(self, texts: pa.Array) -> pa.Array:
        """Sorted topics of each text of a string array."""
        texts = texts.cast(pa.large_string())
        valid = np.asarray(texts.is_valid())
        texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return pa.array([], pa.list_(pa.string()))
        _, bounds, data = texts.buffers()
        offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        keys = [np.flatnonzero(valid)[:, None] * len(self.names) + np.array(self.always, np.int64)]
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
            doc, state = self.hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            times = self.starts[state + 1] - self.starts[state]
            place = np.repeat(self.starts[state] - np.cumsum(times) + times, times) + np.arange(times.sum())
            keys.append((a + np.repeat(doc, times)) * len(self.names) + self.topics[place])
            a = b
        keys = np.unique(np.concatenate([k.ravel() for k in keys]))
        at = np.searchsorted(keys, np.arange(n + 1) * len(self.names))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(self.names, pa.string()).take(pa.array(keys % max(len(self.names), 1))))


class Tagger:
    """A vocabulary, ready to be run over columns of texts.  Build it once; its automata are broadcast once."""

    def __init__(self, spark: SparkSession, keywords: Mapping[str, Sequence[str]] | DataFrame, part_bytes: int = PART_BYTES):
        ship(spark)
        if isinstance(keywords, DataFrame):
            rows = keywords.select(F.lower("keyword").alias("k"), F.col("topic").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
            size = rows.agg(F.sum(F.octet_length("k"))).first()[0] or 0
            self.parts = max(1, -(-size // part_bytes))
            # each fetch brings one part, bounded, to the driver
            of = lambda i: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("k"), F.lit(self.parts)) == i).collect()]
        else:
            pairs = sorted({(k.lower(), t) for k, topics in keywords.items() for t in topics})
            self.parts = max(1, -(-sum(len(k.encode()) for k, _ in pairs) // part_bytes))
            of = lambda i: pairs[i :: self.parts]
        self.spark, self.of = spark, of
        self._shared: dict[int, object] = {}

    def automaton(self, i: int):
        if i not in self._shared:
            self._shared[i] = self.spark.sparkContext.broadcast(Automaton(self.of(i)))
        return self._shared[i]

    def _column(self, text: Column, parts: range) -> Column:
        found = [F.arrow_udf(_run(self.automaton(i)), "array<string>")(F.lower(text)) for i in parts]
        return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*found))))

    def topics(self, text: Column) -> Column:
        """Sorted topics of a text; for vocabularies that one pass takes."""
        if self.parts > A_PASS:
            raise ValueError(f"{self.parts} automata: tag tables with tagged(), in passes of {A_PASS}")
        return self._column(text, range(self.parts))

    def tagged(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, topics of all texts of a key that have any, by as many passes over the texts as the vocabulary needs."""
        out = None
        for a in range(0, self.parts, A_PASS):
            found = df.select(key, self._column(F.col(text), range(a, min(a + A_PASS, self.parts))).alias("__t")).where(F.size("__t") > 0)
            out = found if out is None else out.union(found)
        return out.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__t")))).alias("topics"))


def _run(shared):
    def tag(texts: pa.Array) -> pa.Array:
        return shared.value.tag(texts)

    return tag
