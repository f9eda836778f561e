"""Tables in, stage files in the shared folder, and what workers need to import."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table

__all__ = ["dropped", "fresh_path", "partitions", "released", "shared_dir", "ship", "staged", "table", "unused", "written"]

#: Paths of stage files of this process, in the order they were written.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A folder of this machine only where none is set and all executors are threads of this process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: stage files need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._stage_path = path
    _WRITTEN.append(path)
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stage_path", None):
            _deleted(spark, path)


def written() -> int:
    """A mark for released()."""
    return len(_WRITTEN)


def released(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the stage files written since a mark, but those of ``keep``."""
    kept = {getattr(df, "_stage_path", None) for df in keep}
    for path in _WRITTEN[since:]:
        if path not in kept:
            _deleted(spark, path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores after it until no column is called so (Spark compares names without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
