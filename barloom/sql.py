"""Table functions for SQL: sections of texts, blocks at hard breaks, and chunks packed from ordered paragraphs.

    register(spark)
    SELECT * FROM sections(TABLE(SELECT doc_id, text FROM documents))
    SELECT * FROM text_blocks(TABLE(articles), column => 'body')
    SELECT * FROM packed_chunks(TABLE(SELECT doc_id, line, text FROM paragraphs) PARTITION BY doc_id ORDER BY line, size => 900, overlap => 200)

Each takes a table of any columns, finds the schema of its result when the query is analysed, and keeps the other columns.
Null texts are empty.  packed_chunks takes what PARTITION BY and ORDER BY give it and holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from barloom.operators.sections import breaks_pattern, estimate, split_blocks, split_sections, tail_sentences
from barloom.session import ship


@dataclass
class Shape(AnalyzeResult):
    """Schema of the result, and what eval() needs: the text's column and the columns that are kept."""

    text: str = "text"
    kept: list[str] = field(default_factory=list)
    numbers: tuple[int, ...] = ()


def shaped(table: AnalyzeArgument, column: AnalyzeArgument | None, more: dict, numbers: tuple[int, ...] = (), keep: bool = True) -> Shape:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
    text = "text" if column is None else column.value
    names = {f.name.lower(): f for f in table.dataType.fields}
    if text is None or text.lower() not in names:
        raise ValueError(f"the table has no column {text!r}; it has {', '.join(table.dataType.names)}")
    if not isinstance(names[text.lower()].dataType, StringType):
        raise ValueError(f"{text} is no text")
    text = names[text.lower()].name
    schema, kept = StructType(), []
    for f in table.dataType.fields if keep else ():
        if f.name != text:
            schema = schema.add(f.name, f.dataType, True)
            kept.append(f.name)
    for name, kind in more.items():
        if name in schema.names:
            raise ValueError(f"the table has a column {name}, which the result adds")
        schema = schema.add(name, kind, True)
    return Shape(schema=schema, text=text, kept=kept, numbers=numbers)


class Sections:
    """ordinal, chapter, title, content of each section of a text, after the other columns."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument | None = None) -> Shape:
        return shaped(table, column, {"ordinal": IntegerType(), "chapter": StringType(), "title": StringType(), "content": StringType()})

    def __init__(self, shape: Shape):
        self.shape = shape

    def eval(self, table: Row, column: str | None = None) -> Iterator[tuple]:
        kept = [table[c] for c in self.shape.kept]
        for i, found in enumerate(split_sections(table[self.shape.text] or "")):
            yield (*kept, i, *found)


class TextBlocks:
    """ordinal, title, content of each block of a text between hard breaks; headings are not in the content."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument | None = None) -> Shape:
        return shaped(table, column, {"ordinal": IntegerType(), "title": StringType(), "content": StringType()})

    def __init__(self, shape: Shape):
        self.shape = shape

    def eval(self, table: Row, column: str | None = None) -> Iterator[tuple]:
        kept = [table[c] for c in self.shape.kept]
        for i, found in enumerate(split_blocks(table[self.shape.text] or "")):
            yield (*kept, i, *found)


class PackedChunks:
    """Chunks of about ``size`` tokens from a partition's paragraphs in order: the partition's columns as in its first row, ordinal, content.

    A chunk that is full is given out and its last sentences, up to ``overlap`` tokens, begin the next, unless a pattern that has
    to stay together lies across the boundary.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, column: AnalyzeArgument | None = None) -> Shape:
        for name, x in (("size", size), ("overlap", overlap)):
            if not isinstance(x.value, int) or x.value < 0:
                raise ValueError(f"{name} is a constant number of tokens")
        return shaped(table, column, {"ordinal": IntegerType(), "content": StringType()}, (size.value, overlap.value))

    def __init__(self, shape: Shape):
        self.shape, self.kept, self.chunk, self.used, self.ordinal = shape, None, "", 0, 0

    def _out(self) -> tuple:
        self.ordinal += 1
        return (*self.kept, self.ordinal - 1, self.chunk)

    def eval(self, table: Row, size: int, overlap: int, column: str | None = None) -> Iterator[tuple]:
        if self.kept is None:
            self.kept = [table[c] for c in self.shape.kept]
        most, repeat = self.shape.numbers
        for paragraph in filter(None, map(str.strip, (table[self.shape.text] or "").split("\n\n"))):
            cost = estimate(paragraph)
            full = bool(self.chunk) and self.used + cost > most
            if full and not breaks_pattern(self.chunk, paragraph):
                yield self._out()
                self.chunk = "\n\n".join(filter(None, [tail_sentences(self.chunk, repeat), paragraph]))
                self.used = estimate(self.chunk)
            else:
                self.chunk = f"{self.chunk}\n\n{paragraph}" if self.chunk else paragraph
                self.used = estimate(self.chunk) if full else self.used + cost

    def terminate(self) -> Iterator[tuple]:
        if self.chunk:
            yield self._out()


FUNCTIONS = {"sections": Sections, "text_blocks": TextBlocks, "packed_chunks": PackedChunks}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
