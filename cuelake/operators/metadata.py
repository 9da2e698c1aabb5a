"""Joins of documents with web articles and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WEB_FIELDS = ["web_title", "web_date", "web_date_ts", "web_description", "web_url"]


def attach(docs: DataFrame, articles: DataFrame, required: bool = False) -> DataFrame:
    """Documents with their article by video_hash; with required, only those that have one. The planner picks the join."""
    return docs.join(articles, "video_hash", "inner" if required else "left")


def enrich(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Fills web fields of hits that have none at all, mirrors the web date and tells which rows changed."""
    empty = F.lit(True)
    for f in WEB_FIELDS:
        empty = empty & (F.coalesce(F.col(f).cast("string"), F.lit("")) == "")
    found = articles.select("video_hash", *[F.col(f).alias("new_" + f) for f in WEB_FIELDS], F.lit(True).alias("__hit"))
    joined = hits.join(found, "video_hash", "left").withColumn("enriched", empty & F.coalesce("__hit", F.lit(False)))
    for f in WEB_FIELDS:
        joined = joined.withColumn(f, F.when(F.col("enriched"), F.col("new_" + f)).otherwise(F.col(f)))
    date = F.when(F.col("enriched"), F.coalesce(F.nullif(F.col("web_date"), F.lit("")), F.col("date"))).otherwise(F.col("date"))
    return joined.withColumn("date", date).select(*hits.columns, "enriched")


def first_source(keys: DataFrame, *sources: DataFrame, on: str = "video_hash", value: str = "value") -> DataFrame:
    """A value from the first source that has it, and the number of that source."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(on, F.col(value).alias(f"__{i}")), on, "left")
    found = [F.col(f"__{i}") for i in range(len(sources))]
    place = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(found)])
    return out.withColumn(value, F.coalesce(*found)).withColumn("matched_by", place.cast("int")).drop(*[f"__{i}" for i in range(len(sources))])


def search_titles(articles: DataFrame, wanted: str, limit: int) -> DataFrame:
    """Titles that contain the text: equal, then beginning with it, then others; the newest first. Adds place."""
    name, text = F.lower("name"), F.lit(wanted.lower())
    tier = F.when(name == text, 0).when(F.startswith(name, text), 1).otherwise(2)
    found = articles.where(F.contains(name, text)).withColumn("__tier", tier)
    top = found.orderBy("__tier", F.desc("date_active_start"), "key").limit(limit)  # bounded by the limit before it is numbered
    return top.withColumn("place", F.row_number().over(W.orderBy("__tier", F.desc("date_active_start"), "key")).cast("int")).drop("__tier")


def title_match(articles: DataFrame, wanted: str) -> DataFrame:
    """One article: an equal title (trimmed, case aside) before the first that contains it."""
    name, text = F.trim(F.lower("name")), wanted.strip().lower()
    return articles.where(F.contains(name, F.lit(text))).orderBy(F.when(name == text, 0).otherwise(1), "key").limit(1)


def best_media(files: DataFrame) -> DataFrame:
    """files: video, name. The best file of each video: by quality suffix, then the plain name, then any that begins with it."""
    # Fixed order of qualities.
    order = ["1080p", "720p", "480p", "360p", "180p"]
    quality = F.array_position(F.array(*map(F.lit, order)), F.regexp_extract("name", r"_(\d+p)\.[^.]+$", 1))
    plain = F.regexp_replace("name", r"\.[^.]+$", "") == F.col("video")
    tier = F.when(quality > 0, quality).when(plain, 10).when(F.startswith("name", F.col("video")), 20)
    ranked = files.withColumn("tier", tier).where("tier is not null")
    return ranked.groupBy("video").agg(F.min_by("name", F.struct("tier", "name")).alias("name"))


def split_languages(files: DataFrame) -> DataFrame:
    """files: video_hash, language, path. One row per video with a path for each language."""
    return files.groupBy("video_hash").pivot("language", ["ru", "en"]).agg(F.min("path"))


def union_first(local: DataFrame, remote: DataFrame, key: str = "video_hash") -> DataFrame:
    """Local rows, then remote ones; of a key (or, without one, a URL) the first wins."""
    both = local.withColumn("__o", F.lit(0)).unionByName(remote.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    same = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col("url"))
    return both.withColumn("__r", F.row_number().over(W.partitionBy(same).orderBy("__o", "url"))).where("__r = 1").drop("__o", "__r")


def missing_files(hashes: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct hashes without an English caption file; `h_en.vtt` counts before `h.en.vtt`."""
    english = files.where(F.col("path").rlike(r"[_.]en\.vtt$")).select(F.regexp_extract("path", r"([^/]*)[_.]en\.vtt$", 1).alias("video_hash"))
    return hashes.select("video_hash").distinct().join(english, "video_hash", "left_anti")


def english_file(files: DataFrame) -> DataFrame:
    """video_hash, path of its English caption file."""
    e = files.where(F.col("path").rlike(r"[_.]en\.vtt$")).select(F.regexp_extract("path", r"([^/]*)[_.]en\.vtt$", 1).alias("video_hash"), "path", F.col("path").rlike(r"\.en\.vtt$").cast("int").alias("late"))
    return e.groupBy("video_hash").agg(F.min_by("path", F.struct("late", "path")).alias("path"))


def media_relative(paths: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """paths: path. relative: what is left below the root, else after the root's name, else the shard folders of the hash, if such a file exists (files: relative)."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    p = F.col("path")
    under = F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substring(p, len(root.rstrip("/")) + 2, 10_000))
    marked = F.nullif(F.regexp_extract(p, f"^.*/{name}/(.+)$", 1), F.lit(""))
    file = F.regexp_extract(p, r"([^/]*)$", 1)
    digits = F.lower(F.regexp_extract(file, r"^([0-9a-fA-F]{40})(?:_[^.]*)?(?:\.(?:ru|en))?\.[^.]+$", 1))
    sharded = F.when(digits != "", F.concat(F.regexp_replace(digits, "(..)", "$1/"), file))
    there = files.select(F.col("relative").alias("__f")).distinct().withColumn("__ok", F.lit(True))
    out = paths.withColumn("__a", under).withColumn("__m", marked).withColumn("__s", sharded)
    for c in ("__m", "__s"):
        out = out.join(there.withColumnRenamed("__f", c).withColumnRenamed("__ok", f"{c}ok"), c, "left")
    return out.withColumn("relative", F.coalesce("__a", F.when(F.col("__mok"), F.col("__m")), F.when(F.col("__sok"), F.col("__s")))).drop("__a", "__m", "__s", "__mok", "__sok")


def source_videos(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Caption files with date (of the video's modification) and duration of the video with the same hash."""
    v = videos.groupBy("video_hash").agg(F.min_by(F.struct("mtime", "duration_seconds"), "name").alias("v"))
    out = files.join(v, "video_hash", "left")
    return out.select(*files.columns, F.date_format(F.timestamp_seconds("v.mtime"), "yyyy-MM-dd").alias("date"), F.col("v.mtime").alias("date_ts"), F.col("v.duration_seconds").alias("duration_seconds"))


def sheet_cells(matches: DataFrame) -> DataFrame:
    """matches: row, video_hash. One cell per sheet row with its distinct hashes, for rows that have any."""
    return matches.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("video_hash")), ", ").alias("cell"))


def response_chunks(hits: DataFrame, archive: bool = True) -> DataFrame:
    """Hits as a response shows them: archive paths whole, session paths by their name only."""
    from cuelake.functions.text import parent_name, stem

    name = F.col("path") if archive else F.regexp_extract("path", r"([^/]*)$", 1)
    base = F.regexp_replace(stem(name), r"\.(en|ru)$", "")
    group = F.concat_ws("/", F.nullif(parent_name(name), F.lit("")), base)
    return hits.withColumn("filename", name).withColumn("group_id", group).drop("path")


def silence_centers(marks: DataFrame) -> DataFrame:
    """marks: path, i, kind (start or end), seconds. Middles of silences that were opened and closed in turn."""
    w = W.partitionBy("path").orderBy("i")
    s = F.greatest("seconds", F.lit(0.0))
    m = marks.withColumn("seconds", s).withColumn("before", F.lag("kind").over(w)).withColumn("since", F.lag("seconds").over(w))
    return m.where("kind = 'end' and before = 'start' and seconds >= since").select("path", ((F.col("since") + F.col("seconds")) / 2).alias("center"))
