"""Web sources: link pages, archive indexes, retry classes, progress, article heuristics."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barloom.compat import strip
from barloom.functions.text import plausible_author, without_page_suffix

# Status codes worth another try, least characters of an article.
TRANSIENT = [403, 408, 429]
LEAST_ARTICLE = 200


def article_links(pages: DataFrame, key: str, html: str, base: str, pattern: str = r"/article/\d+/") -> DataFrame:
    """key, urls: links of a page whose path matches, absolute, in order and without repeats."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"""href=["']([^"']*{pattern}[^"']*)["']"""), F.lit(1))
    full = F.transform(found, lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(base.rstrip("/")), u)))
    return pages.select(key, F.array_distinct(full).alias("urls"))


def has_next_page(html: Column, current: Column) -> Column:
    """Some link starts at a later item."""
    starts = F.transform(F.regexp_extract_all(html, F.lit(r"start=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.exists(starts, lambda x: x > current)


def latest_captures(index: DataFrame, skip: str, allow: str) -> DataFrame:
    """urlkey, original, timestamp: latest capture of each key whose URL is allowed and not skipped."""
    rows = index.where(~F.col("original").rlike(skip) & F.col("original").rlike(allow))
    out = rows.groupBy("urlkey").agg(F.max("timestamp").alias("timestamp"), F.min_by("original", F.struct(F.lit(0), "position")).alias("__first"), F.max_by("original", F.struct("timestamp", -F.col("position"))).alias("original"))
    return out.select("urlkey", "original", "timestamp").orderBy("urlkey")


def retry_class(status: Column) -> Column:
    """ok / transient / permanent."""
    return F.when(status.between(200, 299), "ok").when(status.isin(TRANSIENT) | (status >= 500), "transient").otherwise("permanent")


def backoff_seconds(attempt: Column, base: float = 1.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def pending(urls: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """URLs that are not done, in order of position."""
    rest = urls.join(done.select("url"), "url", "left_anti").orderBy("position", "url")
    return rest if limit is None else rest.limit(limit)


def article(title: Column, author: Column, text: Column, archived: bool = False) -> Column:
    """struct(title, author, text, status): an unlikely author is null; a short text is rejected, for good unless archived."""
    short = F.length(F.coalesce(text, F.lit(""))) < LEAST_ARTICLE
    status = F.when(short, "retry" if archived else "skip").otherwise("ok")
    return F.struct(without_page_suffix(title).alias("title"), F.when(plausible_author(author), author).alias("author"), text.alias("text"), status.alias("status"))


def head_title(html: Column) -> Column:
    """Content of the title element, else of the first heading."""
    inside = lambda tag: strip(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.coalesce(F.nullif(inside("title"), F.lit("")), F.nullif(inside("h1"), F.lit("")))


class PageRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class CrawlSource(DataSource):
    """Listing pages start, start + step, ... through ``fetch`` (option: module:function), one partition a range of pages.

    As a batch: ``pages`` pages.  As a stream: all pages that there are, up to ``pages`` if that is given; a page that links to a later
    one has a successor.  The stream's offset is the number of pages read, so its checkpoint is the progress of the crawl: a query that
    is stopped goes on with the first page it has not finished, and pages that came since are read in the next batch.
    """

    @classmethod
    def name(cls) -> str:
        return "barloom_crawl"

    def schema(self) -> str:
        return "position int, url string, status int, html string"

    def reader(self, schema) -> DataSourceReader:
        return CrawlReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CrawlStream(dict(self.options))


class Listing:
    """The pages of a listing, by options of the source."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.step = int(options.get("step", 1))

    def ranges(self, start: int, end: int) -> list[InputPartition]:
        size = int(self.options.get("pagesPerTask", 10))
        return [PageRange(i, min(end, i + size)) for i in range(start, end, size)]

    def page(self, i: int) -> tuple[int, str, int, str]:
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        url = f"{self.options['path']}{'&' if '?' in self.options['path'] else '?'}start={i * self.step}"
        status, html = getattr(importlib.import_module(module), function)(url)
        return (i, url, status, html)

    def has_next(self, i: int) -> bool:
        """Some link of the page starts at a later item."""
        _, _, status, html = self.page(i)
        return 200 <= status < 300 and any(int(x) > i * self.step for x in re.findall(r"start=(\d+)", html or ""))

    def count(self, known: int) -> int:
        """How many pages there are, of which ``known`` are known: by doubling steps, then halves, so few pages are asked."""
        low, jump = max(known, 1), 1
        if not self.has_next(low - 1):
            return low
        low += 1
        while self.has_next(low - 1 + jump):
            low, jump = low + jump + 1, jump * 2
        # low pages are there, and none after low + jump
        high = low + jump
        while low < high:
            middle = (low + high) // 2
            if self.has_next(middle - 1):
                low = middle + 1
            else:
                high = middle
        return low


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.listing.ranges(0, int(self.listing.options.get("pages", 1)))

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return map(self.listing.page, range(partition.start, partition.end))


class CrawlStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.listing, self.known = Listing(options), 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        most = self.listing.options.get("pages")
        if most is None or self.known < int(most):
            self.known = self.listing.count(self.known)
        if most is not None:
            self.known = min(self.known, int(most))
        return {"page": self.known}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.known = max(self.known, end["page"])
        return self.listing.ranges(start["page"], end["page"])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return map(self.listing.page, range(partition.start, partition.end))


def crawled_links(spark: SparkSession, url: str, base: str, fetch: str, pattern: str = r"/article/\d+/", **options: str) -> DataFrame:
    """Stream of (url, position): each article of a listing once, over all pages, batches and restarts."""
    from barloom.streaming.state import FirstSeen

    register(spark)
    pages = spark.readStream.format("barloom_crawl").options(fetch=fetch, **options).load(url)
    links = article_links(pages.where(F.col("status").between(200, 299)), "position", "html", base, pattern)
    rows = links.select(F.explode("urls").alias("url"), "position")
    return rows.groupBy("url").transformWithState(FirstSeen("position"), outputStructType=rows.schema, outputMode="append", timeMode="none")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CrawlSource)


def same_host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def is_article(url: str, pattern: str = r"/article/\d+/") -> bool:
    return re.search(pattern, url) is not None
