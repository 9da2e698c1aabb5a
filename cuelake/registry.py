"""Where queries are registered together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Bytes from which a table's few large row groups are worth a shuffle.
WORTH = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files can't be split among the cores is dealt out first, as one row group is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < WORTH or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
