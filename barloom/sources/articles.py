"""Articles of live and archived pages: container, title, author and text from a tolerant element tree."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import ship
from barloom.sources.files import BLOCKS, DROPPED, LINES, VOID, references, tidy

# Containers of an article in order (tag, attribute, pattern), and what is not part of it, by kind of site.
LIVE = [("div", "class", r"^sub_page_main_area_half_container_left$"), ("div", "class", r"article[-_]?(content|body|text)"), ("article", None, ""), ("main", None, ""), (None, "id", r"content"), ("body", None, "")]
LIVE_ASIDE = (("div",), r"seealso|comments|author_bio")
ARCHIVED = [("div", "class", r"entry[-_]content"), ("div", "class", r"post[-_]content"), ("article", None, ""), ("main", None, ""), ("body", None, "")]
ARCHIVED_ASIDE = (("div", "section", "ul"), r"share|related|comment|nav|sidebar|meta")
ARCHIVED_TITLE = [("h1", "class", r"entry[-_]title|post[-_]title"), ("h2", "class", r"entry[-_]title|post[-_]title")]
PLAUSIBLE, LEAST_TITLE, LEAST_ARTICLE = r"^[A-Z][a-zA-Z\s\-\.]{3,40}$", 6, 200
SILENT = {"script", "style"}
FIELDS = "title string, author string, text string, status string"


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def first(self, tag: str | None, attr: str | None = None, pattern: str = "") -> Element | None:
        """The first element of a tag one of whose classes, or whose id, has the pattern in it."""
        for e in self.walk():
            if tag in (None, e.tag):
                values = [""] if attr is None else (e.attrs.get(attr) or "").split() or [None]
                if any(v is not None and re.search(pattern, v, re.I) for v in values):
                    return e
        return None

    def without(self, tags: set[str] | tuple[str, ...], pattern: str | None = None) -> Element:
        """A copy without the elements below it of some tags (whose class has the pattern in it)."""
        gone = lambda e: e.tag in tags and (pattern is None or re.search(pattern, e.attrs.get("class") or "", re.I))
        return Element(self.tag, self.attrs, [c if isinstance(c, str) else c.without(tags, pattern) for c in self.children if isinstance(c, str) or not gone(c)])

    def strings(self, blocks: bool = False) -> Iterator[str]:
        """Texts in order; blocks: with line ends for elements that make them."""
        if self.tag in SILENT:
            return
        mark = "\n\n" if self.tag in BLOCKS else "\n" if self.tag in LINES else ""
        if blocks and mark:
            yield mark
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings(blocks)
        if blocks and mark:
            yield mark

    def lines(self) -> list[str]:
        """Lines with text, trimmed."""
        return [x for s in self.strings() for x in map(str.strip, s.strip().split("\n")) if x]

    def text(self) -> str:
        return tidy("".join(self.strings(blocks=True)))


class Tree(HTMLParser):
    """Builds elements; an end tag closes what is open inside it, one without a start is ignored."""

    MOST_DEPTH = 200

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID and len(self.open) < self.MOST_DEPTH:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parsed(html: str) -> Element:
    tree = Tree()
    tree.feed(references(html))
    tree.close()
    return tree.root


def head_of(root: Element, suffix: str) -> str:
    """The page's title without the site's name, which begins at ``suffix``."""
    title = root.first("title")
    found = "".join(title.strings()).strip() if title else ""
    return re.sub(suffix, "", found, flags=re.I).strip() if suffix else found


def live_article(html: str, author: str, suffix: str = "") -> tuple[str, str, str, str]:
    """(title, author, text, status): first lines of the container are title and author; a short text is given up."""
    root = parsed(html)
    main = root.first(*LIVE[0])
    if main is not None:
        main = main.without(*LIVE_ASIDE)
    else:
        root_ = root.without(DROPPED)
        main = next((e for c in LIVE[1:] if (e := root_.first(*c)) is not None), None)
    if main is None:
        return "", author, "", "skip"
    lines = main.lines()
    title = lines[0] if lines and len(lines[0]) >= LEAST_TITLE else head_of(root, suffix)
    if len(lines) > 1 and re.match(PLAUSIBLE, lines[1]) and not re.search(r"\d", lines[1]):
        author = lines[1]
    text = main.text()
    return title, author, text, "ok" if len(text) >= LEAST_ARTICLE else "skip"


def archived_article(html: str, url: str, author: str, suffix: str = "") -> tuple[str, str, str, str]:
    """(title, author, text, status): as live_article, by the marks of archived pages; a short text is tried again."""
    root = parsed(html)
    heading = next((e for c in ARCHIVED_TITLE if (e := root.first(*c)) is not None), None)
    title = " ".join(heading.lines()) if heading is not None else ""
    title = title or head_of(root, suffix) or url
    main = next((e for c in ARCHIVED[:3] if (e := root.first(*c)) is not None), None)
    if main is None:
        root_ = root.without(DROPPED)
        main = next((e for c in ARCHIVED[3:] if (e := root_.first(*c)) is not None), None)
    if main is None:
        return title, author, "", "skip"
    text = main.without(*ARCHIVED_ASIDE).text()
    return title, author, text, "ok" if len(text) >= LEAST_ARTICLE else "retry"


def decoded(content: bytes) -> str:
    """The text of a page's bytes: by its own charset if it names one that fits, else UTF-8, else one byte a character."""
    named = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", content[:4096], re.I)
    for charset in [*([named.group(1).decode()] if named else []), "utf-8"]:
        try:
            return content.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("latin-1")


def articles(pages: DataFrame, html: str = "html", url: str = "url", archived: bool = False, author: str = "", suffix: str = "") -> DataFrame:
    """Adds title, author, text and status (ok, skip for good, retry later) of each page; html is text or bytes.  Null pages are empty."""
    ship(pages.sparkSession)
    columns = [c for c in pages.columns if c not in ("title", "author", "text", "status")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns] + [FIELDS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(columns)
            rows = []
            for page, at in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                page = decoded(page) if isinstance(page, bytes) else page or ""
                rows.append(archived_article(page, at or "", author, suffix) if archived else live_article(page, author, suffix))
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], names=[*columns, "title", "author", "text", "status"])

    return pages.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{html}`").alias("__html"), F.col(f"`{url}`").alias("__url")).mapInArrow(work, schema)


def retrying(fetch: Callable[[str], tuple[int, object]], attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[int, object, bool]]:
    """fetch(url) -> (status, body) with further tries after transient failures: (status, body or None, failed for good).

    Waits base * 2 ** attempt seconds between tries.  A fetch that raises is a transient failure of status 0.
    """

    def get(url: str) -> tuple[int, object, bool]:
        status = 0
        for attempt in range(1, attempts + 1):
            try:
                status, body = fetch(url)
            except Exception:  # the network: worth another try
                status, body = 0, None
            if 200 <= status < 300:
                return status, body, False
            if status and status not in (403, 408, 429) and status < 500:
                return status, None, True
            if attempt < attempts:
                sleep(base * 2**attempt)
        return status, None, False

    return get
