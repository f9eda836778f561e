"""A sink that commits rows in units, with an audit row a unit after the commit: Python data source ``barloom_committed``.

Tasks write units of ``rowsPerCommit`` rows as Parquet files that nobody reads yet, numbered by task, and tell the driver how many
they wrote.  The driver commits a write by putting one manifest in its place, and writes the audit after that; both have an entry a
task, whatever the number of units, and audit() gives a row a unit.  A task that fails takes its own files with it, a write that
fails takes those of its other tasks: neither rows nor audit rows stay.  Reading the source gives the rows of committed units alone,
many units a task.

As a stream sink a batch commits once: a batch that is run again after its commit changes nothing, but for audit rows that
are missing.  ``path`` is a folder that all executors share and pyarrow's file systems can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from barloom.session import BATCH_ROWS, ship

UNIT_ROWS = 50
#: Units and rows that one task reads at most (one unit at least).
READ_UNITS, READ_ROWS = 250, 100_000


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files ``prefix``-000000.parquet and so on, each of ``size`` rows but the last."""

    prefix: str
    units: int
    n_rows: int
    size: int

    def names(self) -> list[str]:
        return [unit_name(self.prefix, i) for i in range(self.units)]


@dataclass
class UnitFiles(InputPartition):
    prefix: str
    begin: int
    end: int


def unit_name(prefix: str, i: int) -> str:
    return f"{prefix}-{i:06d}.parquet"


class Folder:
    """Files below ``path``, by pyarrow's file systems."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))

    def put(self, folder: str, name: str, value: object) -> None:
        """A whole file, or none."""
        self.fs.create_dir(f"{self.root}/{folder}")
        ready = f"{self.root}/{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(ready) as out:
            out.write(json.dumps(value).encode())
        self.fs.move(ready, f"{self.root}/{folder}/{name}")

    def get(self, folder: str, name: str) -> object:
        with self.fs.open_input_stream(f"{self.root}/{folder}/{name}") as f:
            return json.loads(f.read())

    def remove(self, names: Sequence[str]) -> None:
        from pyarrow import fs

        for name in names:
            if self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/{name}")


def units_of(folder: Folder, batches: Iterator[pa.RecordBatch], size: int, at: str = "units") -> Written:
    """Write a task's rows in units below ``at``; on failure none stays."""
    import pyarrow.parquet as pq

    done = Written(f"{at}/{uuid.uuid4().hex}", 0, 0, size)
    held: list[pa.RecordBatch] = []

    def flush() -> None:
        table = pa.Table.from_batches(held)
        name = unit_name(done.prefix, done.units)
        done.units += 1
        done.n_rows += len(table)
        pq.write_table(table, f"{folder.root}/{name}", filesystem=folder.fs)
        held.clear()

    folder.fs.create_dir(f"{folder.root}/{at}")
    try:
        for batch in batches:
            begin = 0
            while begin < len(batch):
                held.append(batch.slice(begin, size - sum(map(len, held))))
                begin += len(held[-1])
                if sum(map(len, held)) == size:
                    flush()
        if held:
            flush()
    except BaseException:
        folder.remove(done.names())
        raise
    return done


def committed(folder: Folder, name: str, messages: Sequence[Written | None]) -> None:
    """One manifest, then one file of audit entries."""
    tasks = [m for m in messages if m and m.units]
    if f"{name}.json" in folder.names("commits"):  # a batch that is run again: the first commit stands
        for m in tasks:
            folder.remove(m.names())
        tasks = [Written(**x) for x in folder.get("commits", f"{name}.json")]
    else:
        folder.put("commits", f"{name}.json", [asdict(m) for m in tasks])
    if f"{name}.json" not in folder.names("audit"):
        first = accumulate((m.units for m in tasks), initial=0)
        folder.put("audit", f"{name}.json", [{"write": name, "first": i, **asdict(m)} for i, m in zip(first, tasks)])


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.name = path, size, f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return units_of(Folder(self.path), iterator, self.size, f"units/{self.name}")

    def commit(self, messages: list[Written | None]) -> None:
        committed(Folder(self.path), self.name, messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Also what tasks left that were killed; one that still runs fails without its folder."""
        from pyarrow import fs

        folder = Folder(self.path)
        if folder.fs.get_file_info(f"{folder.root}/units/{self.name}").type == fs.FileType.Directory:
            folder.fs.delete_dir(f"{folder.root}/units/{self.name}")


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, size: int, name: str):
        self.path, self.size, self.name = path, size, name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return units_of(Folder(self.path), iterator, self.size)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        committed(Folder(self.path), f"{self.name}-{batchId:012d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).remove([n for m in messages if m for n in m.names()])


class UnitReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> Sequence[InputPartition]:
        folder, out = Folder(self.path), []
        for m in (Written(**x) for name in folder.names("commits") for x in folder.get("commits", name)):
            step = max(1, min(READ_UNITS, READ_ROWS // m.size))
            out += [UnitFiles(m.prefix, i, min(i + step, m.units)) for i in range(0, m.units, step)]
        return out

    def read(self, partition: UnitFiles) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        folder, held = Folder(self.path), []
        for i in range(partition.begin, partition.end):
            with folder.fs.open_input_file(f"{folder.root}/{unit_name(partition.prefix, i)}") as f:
                held.append(pq.ParquetFile(f).read(self.columns, use_threads=False).select(self.columns))
            if i + 1 == partition.end or sum(map(len, held)) >= BATCH_ROWS:
                yield from pa.concat_tables(held).combine_chunks().to_batches(BATCH_ROWS)
                held.clear()


class CommittedSource(DataSource):
    """Options: path, rowsPerCommit (50), query (the name of a stream, so that its batches have names of their own)."""

    @classmethod
    def name(cls) -> str:
        return "barloom_committed"

    def schema(self) -> str:
        raise ValueError("give the schema of the rows: spark.read.format('barloom_committed').schema(...)")

    def _size(self) -> int:
        return int(self.options.get("rowsPerCommit", UNIT_ROWS))

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("barloom_committed appends")
        return BatchWriter(self.options["path"], self._size())

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self._size(), self.options.get("query", "stream"))

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CommittedSource)


def write(df: DataFrame, path: str, rows_per_commit: int = UNIT_ROWS) -> None:
    """Append rows in units, with their audit rows: all of them, or none."""
    register(df.sparkSession)
    df.write.format("barloom_committed").mode("append").option("rowsPerCommit", rows_per_commit).save(path)


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of committed units."""
    register(spark)
    return spark.read.format("barloom_committed").schema(schema).load(path)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """write, unit, file, n_rows: an audit row a unit."""
    tasks = spark.read.schema("write string, first long, prefix string, units long, n_rows long, size long").json(f"{path}/audit/*.json")
    units, i = tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("units") - 1))), F.col("i")
    file = F.format_string("%s-%06d.parquet", "prefix", i)
    return units.select("write", (F.col("first") + i).cast("int").alias("unit"), file.alias("file"), F.least("size", F.col("n_rows") - i * F.col("size")).alias("n_rows"))
