"""Caption files: scanning, parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelake.functions.text import clean_text, seconds_of, stamp_ms_of, video_hash

MAX_FILE = 10 * 1024 * 1024
TIMING = r"^\d{2}:\d{2}:\d{2}\.\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}\.\d{3}"
CUE_ID = r"^[a-zA-Z0-9_-]+$"
LOOSE_TIMING = r"((?:\d{2}:)?\d{2}:\d{2}[.,]\d{3})[ \t]+-->[ \t]+((?:\d{2}:)?\d{2}:\d{2}[.,]\d{3})([^\n]*)"


def scan(spark: SparkSession, root: str, max_size: int = MAX_FILE, pattern: str = "*.vtt") -> DataFrame:
    """path, mtime, size, file_hash and content of all caption files under a folder; larger ones are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where(F.col("length") <= max_size)
    return files.select("path", F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), F.col("content").cast("string").alias("content"))


def scan_known(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Only files whose video hash is listed."""
    return files.withColumn("video_hash", video_hash(F.col("path"))).join(hashes.select("video_hash"), "video_hash", "left_semi")


def is_valid(content: Column) -> Column:
    return F.startswith(F.trim(F.split(content, "\n")[0]), F.lit("WEBVTT"))


def parse(files: DataFrame, key: str = "path") -> DataFrame:
    """files: key, content. key, rn, start_time, end_time, start_s, end_s, text of every cue of the valid files.

    Blank lines end a block; a block's cue has its last timing line and all its text lines. A line is a cue id only if
    the next is a timing line; notes are left out; milliseconds are cut; cues without text are left out. A valid file
    without speech has no rows, nor has an invalid one; tell them apart with is_valid.
    """
    lines = files.where(is_valid(F.col("content"))).select(key, F.posexplode(F.split("content", "\n")).alias("i", "line"))
    w = W.partitionBy(key).orderBy("i")
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    marked = lines.withColumn("line", line).withColumn("next", F.lead("line").over(w)).withColumn("block", F.sum((F.col("line") == "").cast("int")).over(w))
    timing = F.col("line").rlike(TIMING)
    is_id = F.col("line").rlike(CUE_ID) & F.coalesce(F.col("next").rlike(TIMING), F.lit(False))
    text = ~timing & (F.col("line") != "") & ~is_id & ~F.startswith(F.upper("line"), F.lit("NOTE"))
    body = marked.where("i > 0")
    blocks = body.groupBy(key, "block").agg(F.max_by(F.when(timing, F.col("line")), F.when(timing, F.col("i"))).alias("timing"), F.array_sort(F.collect_list(F.when(text, F.struct("i", "line")))).alias("texts"))
    said = clean_text(F.array_join(F.transform("texts", lambda t: t["line"]), " "))
    start, end = (F.regexp_extract("timing", p, 1) for p in (r"^(\d{2}:\d{2}:\d{2})", r"-->\s*(\d{2}:\d{2}:\d{2})"))
    cues = blocks.where("timing is not null").select(key, "block", start.alias("start_time"), end.alias("end_time"), said.alias("text")).where("text <> ''")
    rn = F.row_number().over(W.partitionBy(key).orderBy("block")).cast("int")
    return cues.select(key, rn.alias("rn"), "start_time", "end_time", seconds_of(F.col("start_time")).alias("start_s"), seconds_of(F.col("end_time")).alias("end_s"), "text")


def parse_blocks(files: DataFrame, key: str = "path", offset: float = 0.0) -> DataFrame:
    """The lenient parser: short stamps, decimal commas, settings kept, an offset added. key, rn, start_s, end_s, text, settings."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    blocks = files.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n\s*")).alias("block", "b"))
    found = lambda i: F.regexp_extract("b", r"(?m)^[ \t]*" + LOOSE_TIMING + "$", i)
    said = F.regexp_replace(F.regexp_extract("b", r"(?s)(?m:^[ \t]*" + LOOSE_TIMING + r"$)\n?(.*)", 4), r"^\s+|\s+$", "")
    rows = blocks.select(key, "block", (seconds_of(found(1)) + offset).alias("start_s"), (seconds_of(found(2)) + offset).alias("end_s"), said.alias("text"), F.trim(found(3)).alias("settings")).where("start_s is not null and text <> ''")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("block")).cast("int")).drop("block")


def render(cues: DataFrame, key: str = "path") -> DataFrame:
    """cues: key, start_s, end_s, text. One caption text per key: in order of start, no cue reaching into the next."""
    w = W.partitionBy(key).orderBy("start_s", "end_s", "text")
    following = F.lead("start_s").over(w)
    end = F.when(following.isNull(), F.col("end_s")).otherwise(F.least("end_s", F.greatest("start_s", following)))
    placed = cues.select(key, F.row_number().over(w).alias("i"), F.concat(stamp_ms_of(F.col("start_s")), F.lit(" --> "), stamp_ms_of(end), F.lit("\n"), "text").alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda b: b["block"]), "\n\n")
    return placed.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace(joined, r"\s+$", ""), F.lit("\n")).alias("content"))


def segments_to_cues(responses: DataFrame, offset: Column) -> DataFrame:
    """responses: key columns and segments array<struct<start, end, text>>. Trimmed, shifted; empty or backward ones left out."""
    keys = [c for c in responses.columns if c != "segments"]
    s = responses.select(*keys, F.explode("segments").alias("s")).select(*keys, (F.col("s.start") + offset).alias("start_s"), (F.col("s.end") + offset).alias("end_s"), F.trim("s.text").alias("text"))
    return s.where("text <> '' and end_s > start_s")
