"""Writers: tables are published whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import metric_name, point_id
from cuelake.operators.incremental import index_diff, latest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def recover(spark: SparkSession, path: str) -> None:
    """Ends a publication that broke off between its two renames: the table is the fresh one, which was written in full, else the old one."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return
    for kind in ("new", "old"):
        for status in fs.globStatus(_fs(spark, f"{path}.{kind}-*")[1]) or []:
            found = status.getPath()
            if kind == "old" or fs.exists(_fs(spark, f"{found.toString()}/_SUCCESS")[1]):
                fs.rename(found, target)
                return


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A published table."""
    recover(spark, path)
    return spark.read.format(kind).load(path)


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes beside the old table and swaps by renaming, so that a plan may read the path it replaces.

    Old and fresh table are both whole whenever a rename is due; `read` and the next `publish` end a swap that broke off.
    """
    spark, fresh, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    recover(spark, path)
    df.write.format(kind).save(fresh)
    fs, target = _fs(spark, path)
    had = fs.exists(target)
    if had:
        fs.rename(target, _fs(spark, old)[1])
    fs.rename(_fs(spark, fresh)[1], target)
    for status in fs.globStatus(_fs(spark, f"{path}.old-*")[1]) or []:
        fs.delete(status.getPath(), True)


def upsert_points(existing: DataFrame | None, docs: DataFrame) -> DataFrame:
    """The table after a batch: point_id from id, a later row of an id (by `seq`) replaces an earlier one."""
    new = latest(docs.withColumn("point_id", point_id(F.col("id"))), "point_id", "seq")
    return new if existing is None else existing.join(new.select("point_id"), "point_id", "left_anti").unionByName(new, allowMissingColumns=True)


def apply_diff(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The table after an incremental run: kept rows as they were, the rest from the new ones."""
    kept = index_diff(existing, new, key).where("action = 'keep'").select(key)
    return existing.join(kept, key, "left_semi").unionByName(new.join(kept, key, "left_anti"), allowMissingColumns=True)


class Collections:
    """Named vector tables in a folder, with a dimension and a distance fixed at creation, and aliases."""

    DISTANCES = ("Cosine", "Euclidean", "Dot")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return exists(self.spark, self._path(name))

    def write(self, name: str, rows: DataFrame, size: int, distance: str = "Cosine") -> None:
        distance = distance if distance in self.DISTANCES else "Cosine"
        wrong = rows.where(F.size("embedding") != size).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of {name} must have {size} components")
        publish(rows.withColumn("distance", F.lit(distance)), self._path(name))

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self._path(self.resolve(name)))

    def drop(self, name: str) -> None:
        delete(self.spark, self._path(name))

    def names(self) -> list[str]:
        return [n for n in folders(self.spark, self.root) if not n.startswith("_alias_") and ".new-" not in n and ".old-" not in n]

    def resolve(self, name: str) -> str:
        alias = f"{self.root}/_alias_{name}"
        recover(self.spark, alias)
        fs, p = _fs(self.spark, alias)
        return self.spark.read.text(alias).first()[0] if fs.exists(p) else name

    def swap(self, alias: str, rows: DataFrame, size: int, distance: str = "Cosine") -> str:
        """Builds a new version, points the alias at it, then drops the version before."""
        before, version = self.resolve(alias), f"{alias}-{uuid.uuid4().hex[:12]}"
        self.write(version, rows, size, distance)
        publish(self.spark.createDataFrame([(version,)], "value STRING").coalesce(1), f"{self.root}/_alias_{alias}", "text")
        if before not in (alias, version):
            self.drop(before)
        return version

    def info(self, name: str) -> tuple[int, str]:
        n = self.read(name).count()
        return n, "green" if n else "empty"


def metric_table(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long metrics (keys, metric, value) to one column a metric: the union of all names; nulls, NaN and infinities are left out."""
    good = metrics.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return good.withColumn("metric", metric_name(F.col("metric"))).groupBy(*keys).pivot("metric").agg(F.first("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def split_errors(results: DataFrame, column: str = "result") -> tuple[DataFrame, DataFrame]:
    """(successes, failures) of a column of struct<value, error>."""
    return results.where(F.col(f"{column}.error").isNull()), results.where(F.col(f"{column}.error").isNotNull())
