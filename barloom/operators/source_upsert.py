"""Upsert of sources as one write: rows of a batch take effect one after the other, so each sees what earlier ones made.

Rules of identity, for rows in order of position:
1. a URL that a source has decides;
2. else title and author (null authors are equal): the source found takes the row, and the row's URL if it has none;
3. but if that source has another URL, the row is a source of its own under a title of its own: the title with the
   last part of the URL's path in brackets, cut to TITLE characters, or with eight digits of the URL's MD5 where that is taken;
4. else the row is a new source.

Later rows of a URL, or of a title without URL, only follow the first.  Rows of different titles meet in no rule unless a
title has brackets of its own or is cut; so plain titles are settled by aggregates, however many rows share one, and only
groups of bracketed or long titles are folded row by row, a group of one stem and author at a time, in a stream whose memory
is the group's sources.

Null and blank URLs are none.  Rows need distinct positions; ids of new sources follow their positions.  An empty batch
changes nothing.  Columns of rows beyond those named are left out; sources keep theirs, null for new sources.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.compat import nullif_blank
from barloom.session import ship, staged

TITLE = 300
#: Characters of a title that tell groups apart; a longer title may be cut to its suffix.
STEM = 250
FOLDED = "id long, title string, author string, source_type string, url string, position long, made boolean"


def marks(url: str) -> tuple[str, str]:
    """What tells a page from others of its title: the last part of its path, and a digest of the URL."""
    return re.search(r"([^/]*)/*$", url)[1], hashlib.md5(url.encode()).hexdigest()[:8]


def own_title(title: str, url: str, taken) -> str:
    """A title for a second page of a title.  The path's mark may be cut off at the end, for the digest the title is cut."""
    part, digest = (f"[{m}]" for m in marks(url))
    by_path = " ".join((title, part))[:TITLE]
    free = by_path != title and by_path not in taken
    return by_path if free else " ".join((title[: TITLE - 1 - len(digest)], digest))


def folded(first_id: int):
    """Fold of a group in order: its old sources (position null), then rows.  Gives its sources as changed or made, and the id of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict[str, dict] = {}
        for batch in batches:
            out = []
            for r in batch.select(["id", "title", "author", "source_type", "url", "position"]).to_pylist():
                if r["position"] is None:
                    sources[r["title"]] = r
                    continue
                title, url = r["title"], r["url"]
                found = sources.get(title)
                if found and url and found["url"] and found["url"] != url:
                    title = own_title(title, url, sources)
                    found = sources.get(title)
                if found is None:
                    found = sources[title] = r | {"id": first_id + r["position"], "title": title, "made": True}
                elif url and not found["url"]:
                    found["url"] = url
                out.append({k: found[k] for k in ("id", "title", "author", "source_type", "url")} | {"position": r["position"], "made": found.get("made", False)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("title", pa.string()), ("author", pa.string()), ("source_type", pa.string()), ("url", pa.string()), ("position", pa.int64()), ("made", pa.bool_())]))

    # the type hints tell Spark that batches of a group come one by one
    return work


def stem(title: Column) -> Column:
    return F.substring(F.substring_index(title, " [", 1), 1, STEM)


def settled(rows: DataFrame, old: DataFrame, first_id: int) -> DataFrame:
    """Rows of FOLDED for plain titles, one a row, by aggregates over title and author.

    rows: title, author, source_type, url, position, leaders only.  old: id, title, author, source_type, url.
    """
    key = ["title", "author"]
    own = old.select(*[F.col(c).alias(f"__{c}") for c in ("title", "author", "id", "source_type", "url")])
    same = F.col("title").eqNullSafe(F.col("__title")) & F.col("author").eqNullSafe(F.col("__author"))
    url_at, first = F.when(F.col("url").isNotNull(), F.struct("position", "url")), F.struct("position", "source_type", "url")
    groups = rows.groupBy(*key).agg(F.min(first).alias("first"), F.min(url_at).alias("by_url")).join(own, same, "left").drop("__title", "__author")
    # the source of the plain title: the old one, or that of the first row; its URL is its own or the first that comes
    groups = groups.select(
        F.col("title").alias("g_title"), F.col("author").alias("g_author"), F.coalesce("__id", F.col("first.position") + first_id).alias("g_id"), F.coalesce("__url", "by_url.url").alias("g_url"),
        F.when(F.col("__id").isNull(), F.col("first.source_type")).otherwise(F.col("__source_type")).alias("g_type"), F.col("__id").isNull().alias("g_made"),
    )
    tall = rows.join(groups, F.col("title").eqNullSafe(F.col("g_title")) & F.col("author").eqNullSafe(F.col("g_author"))).drop("g_title", "g_author")
    part = F.substring_index(F.regexp_replace("url", "/+$", ""), "/", -1)
    tall = tall.withColumn("part", F.when(F.col("url") != F.col("g_url"), part))
    # of rows with one last part of the path the first has it
    holders = tall.where("part IS NOT NULL").groupBy(*key, "part").agg(F.min("position").alias("h_position"))
    holders = holders.select(F.col("title").alias("h_title"), F.col("author").alias("h_author"), F.col("part").alias("h_part"), "h_position")
    held = F.col("title").eqNullSafe(F.col("h_title")) & F.col("author").eqNullSafe(F.col("h_author")) & (F.col("part") == F.col("h_part"))
    tall = tall.join(holders, held, "left")
    named = F.concat("title", F.lit(" ["), F.when(F.col("position") == F.col("h_position"), F.col("part")).otherwise(F.substring(F.md5("url"), 1, 8)), F.lit("]"))
    apart = F.col("part").isNotNull()
    return tall.select(
        F.when(apart, F.col("position") + first_id).otherwise(F.col("g_id")).alias("id"), F.when(apart, named).otherwise(F.col("title")).alias("title"), "author",
        F.when(apart, F.col("source_type")).otherwise(F.col("g_type")).alias("source_type"), F.when(apart, F.col("url")).otherwise(F.col("g_url")).alias("url"), "position", (apart | F.col("g_made")).alias("made"),
    )


def upserted(sources: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources after all rows, position and source_id of each row).

    sources: id, title, author, source_type, url and others.  rows: position, title, author, source_type, url.
    """
    ship(sources.sparkSession)
    first_id = (sources.agg(F.max("id")).first()[0] or 0) + 1
    rows = rows.select("position", F.substring("title", 1, TITLE).alias("title"), "author", "source_type", nullif_blank(F.trim("url")).alias("url"))
    old = sources.select("id", "title", "author", "source_type", nullif_blank(F.trim("url")).alias("url"))
    known = old.where("url IS NOT NULL").groupBy(F.col("url").alias("__u")).agg(F.min("id").alias("__known"))
    rows = staged(rows.join(known, F.col("url") == F.col("__u"), "left").drop("__u"), "sources-rows")

    # of each URL, and of each title without one, the first row leads
    by = F.when(F.col("url").isNotNull(), F.struct(F.col("url").alias("a"), F.lit(None).cast("string").alias("b"))).otherwise(F.struct(F.col("title").alias("a"), F.col("author").alias("b")))
    open_rows = rows.where("__known IS NULL").drop("__known").withColumns({"has_url": F.col("url").isNotNull(), "by": by})
    leaders = open_rows.groupBy("has_url", "by").agg(F.min_by(F.struct("position", "title", "author", "source_type", "url"), "position").alias("r"))
    leaders = staged(leaders.select("has_url", "by", "r.*").withColumn("stem", stem(F.col("title"))), "sources-leaders")

    old = old.withColumn("stem", stem(F.col("title")))
    plain = (F.col("stem") == F.col("title")) & (F.length("title") < STEM)
    touched = leaders.select("stem", "author", "title").unionByName(old.select("stem", "author", "title")).groupBy("stem", "author").agg(F.bool_and(plain).alias("plain"))
    touched = touched.select(F.col("stem").alias("__s"), F.col("author").alias("__a"), "plain")
    sorted_out = lambda df: df.join(touched, F.col("stem").eqNullSafe(F.col("__s")) & F.col("author").eqNullSafe(F.col("__a"))).drop("__s", "__a")
    new, before = sorted_out(leaders), sorted_out(old)
    easy = settled(new.where("plain").select("title", "author", "source_type", "url", "position"), before.where("plain").drop("plain", "stem"), first_id)

    columns = ["stem", "id", "title", "author", "source_type", "url", "position"]
    hard = new.where("NOT plain").withColumn("id", F.lit(None).cast("long")).select(*columns).unionByName(before.where("NOT plain").withColumn("position", F.lit(None).cast("long")).select(*columns))
    order = ["stem", "author", F.asc_nulls_first("position")]
    hard = hard.repartition("stem", "author").sortWithinPartitions(*order)
    changed = staged(easy.select(*[c.split()[0] for c in FOLDED.split(", ")]).unionByName(hard.groupBy("stem", "author").applyInArrow(folded(first_id), FOLDED)), "sources-changed")

    # a source is as its last row left it
    last = changed.groupBy("id").agg(F.max_by(F.struct("title", "author", "source_type", "url", "made"), F.struct(F.col("url").isNotNull(), "position")).alias("r")).select(F.col("id").alias("__id"), "r.*")
    urls = last.where("NOT made").select("__id", F.col("url").alias("__url"))
    kept = sources.join(urls, F.col("id") == F.col("__id"), "left").withColumn("url", F.coalesce(nullif_blank(F.trim("url")), F.col("__url"))).select(*sources.columns)
    after = kept.unionByName(last.where("made").select(F.col("__id").alias("id"), "title", "author", "source_type", "url"), allowMissingColumns=True)

    ids = leaders.select("has_url", F.col("by").alias("__by"), F.col("position").alias("__p")).join(changed.select(F.col("position").alias("__q"), "id"), F.col("__p") == F.col("__q"))
    ids = ids.select(F.col("has_url").alias("__has"), "__by", "id")
    follow = open_rows.join(ids, (F.col("has_url") == F.col("__has")) & F.col("by").eqNullSafe(F.col("__by"))).select("position", F.col("id").alias("source_id"))
    return after, rows.where("__known IS NOT NULL").select("position", F.col("__known").alias("source_id")).unionByName(follow)
