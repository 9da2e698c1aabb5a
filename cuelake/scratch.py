"""Tables that a plan writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/cuelake-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared folder (small tables only)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Removes the shuffle files of a write as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """The rows, written as a compressed table and read again; the write's shuffle files go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once as a table in the shared folder, which goes when the driver ends or by `drop`."""
    path = scratch(df.sparkSession, what)
    _LEFT[path] = df.sparkSession
    out = write(df, path)
    out.stored_at = path
    return out


#: Tables that results may still read.
_LEFT: dict[str, SparkSession] = {}


def left_over(spark: SparkSession, path: str) -> str:
    """The path, noted as one that goes when the driver ends."""
    _LEFT[path] = spark
    return path


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        remove(_LEFT.pop(df.stored_at), df.stored_at)


def left() -> set[str]:
    """Stored tables that are there now."""
    return set(_LEFT)


def drop_since(before: set[str]) -> None:
    """Removes the tables stored since `left` was called."""
    for path in set(_LEFT) - before:
        remove(_LEFT.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for path, spark in _LEFT.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: nothing can be removed through it
            return
