"""Differences between what is stored and what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TOLERANCE = 0.001


def classify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state: new, unchanged, modified or deleted. Equal time (within a millisecond) and size is unchanged; another size is modified; else the hash decides."""
    old = manifest.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("file_hash").alias("h0"), F.lit(True).alias("was"))
    new = files.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.col("file_hash").alias("h1"), F.lit(True).alias("there"))
    same_time = F.abs(F.col("m0") - F.col("m1")) < TOLERANCE
    state = (
        F.when(F.col("was").isNull(), "new").when(F.col("there").isNull(), "deleted").when(F.col("s0") != F.col("s1"), "modified")
        .when(same_time, "unchanged").when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged").otherwise("modified")
    )
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def updated_manifest(manifest: DataFrame, states: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries of deleted and modified files go; files that yielded documents get new ones (docs: path, doc_id)."""
    gone = states.where(F.col("state").isin("deleted", "modified")).select("path")
    ids = docs.groupBy("path").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    fresh = files.join(states.where(F.col("state").isin("new", "modified")).select("path"), "path", "left_semi").join(ids, "path")
    names = ["path", "mtime", "size", "file_hash", "doc_ids"]
    return manifest.join(gone, "path", "left_anti").select(*names).unionByName(fresh.select(*names))


def updated_documents(previous: DataFrame, skip: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """What was there without the skipped keys, and the new rows. Write it beside the old table and swap."""
    return previous.join(skip.select(key).distinct(), key, "left_anti").unionByName(new)


def rebuilt_manifest(files: DataFrame, docs: DataFrame, least: int = 0) -> DataFrame:
    """path with the ordered ids of its documents, from the documents; files without any get an empty list."""
    ids = docs.groupBy("path").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    out = files.join(ids, "path", "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))
    if least and out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} entries")
    return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def index_diff(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """key, action: delete, keep or upsert. Kept are equal, non-null hashes only, so rows without a hash are always written."""
    a = existing.select(key, F.col("content_hash").alias("h0"), F.lit(True).alias("was"))
    b = new.select(key, F.col("content_hash").alias("h1"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "delete").when(F.col("was").isNotNull() & F.col("h1").isNotNull() & (F.col("h0") == F.col("h1")), "keep").otherwise("upsert")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def diff_stats(diff: DataFrame) -> DataFrame:
    """total (new rows), upserted, deleted, unchanged."""
    n = lambda a: F.count_if(F.col("action") == a)
    return diff.agg((n("upsert") + n("keep")).alias("total"), n("upsert").alias("upserted"), n("delete").alias("deleted"), n("keep").alias("unchanged"))


def cached_embeddings(docs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, misses). cache: row, text or content_hash, embedding; the last row of a hash counts."""
    h = F.coalesce("content_hash", F.sha2("text", 256))
    newest = cache.withColumn("content_hash", h).groupBy("content_hash").agg(F.max_by("embedding", "row").alias("embedding"))
    return docs.join(newest, "content_hash"), docs.join(newest.select("content_hash"), "content_hash", "left_anti")


def has_legacy_ids(points: DataFrame, sample: int = 256) -> bool:
    """Whether any of a few points has an id that is no UUID."""
    from cuelake.functions.text import is_uuid

    return bool(points.limit(sample).where(~is_uuid(F.col("point_id").cast("string"))).limit(1).count())
