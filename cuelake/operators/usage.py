"""Usage logs: one key=value line per action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = r"\[usage\] (event=.*)$"


def line(event: Column, fields: dict[str, Column]) -> Column:
    """What a log line says; nulls and empty values are left out."""
    parts = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(k + "="), v.cast("string"))) for k, v in fields.items()]
    return F.concat_ws(" ", F.concat(F.lit("[usage] event="), event), *parts)


def outcome(status: Column, failed: Column) -> Column:
    return F.when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string"))).when(failed, "error").otherwise("ok")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    """lines: value. date, event, source, outcome, reason, via, seconds, bytes of usage lines."""
    found = lines.select(F.regexp_extract("value", MARK, 1).alias("f"), F.nullif(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("date")).where("f <> ''")
    pairs = F.filter(F.split("f", " "), lambda p: F.contains(p, F.lit("=")))
    fields = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"))))
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k)).alias(k)
    return found.select("date", fields.alias("m")).select("date", *[get(k) for k in ("event", "source", "outcome", "reason", "via")], get("seconds").try_cast("double").alias("seconds"), get("bytes").try_cast("long").alias("bytes"))


def report(events: DataFrame, event: str = "video_import") -> DataFrame:
    """Counts by platform, day, backend, reason and in all, from one pass over grouping sets."""
    rows = events.where(F.col("event") == event).select(F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("date", F.lit("?")).alias("date"), F.coalesce("via", F.lit("-")).alias("via"), F.coalesce("reason", F.lit("-")).alias("reason"), (F.coalesce("outcome", F.lit("?")) == "ok").alias("ok"), "bytes")
    dims = ["source", "date", "via", "reason"]
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = rows.groupingSets(sets, *map(F.col, dims)).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("succeeded"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "source").when(F.col("g") == 11, "date").when(F.col("g") == 13, "via").when(F.col("g") == 14, "reason").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce(*dims, F.lit("")).alias("value"), "attempts", "succeeded", "bytes")


def failure_rate(events: DataFrame, least: int, share: float, event: str = "video_import") -> DataFrame:
    """attempts, failed, share and alarm: enough attempts and a share of failures over the limit."""
    a = events.where(F.col("event") == event).agg(F.count("*").alias("attempts"), F.count_if(~F.coalesce(F.col("outcome") == "ok", F.lit(False))).alias("failed"))
    rate = F.col("failed") / F.nullif(F.col("attempts"), F.lit(0))
    return a.select("attempts", "failed", F.round(rate, 6).alias("share"), F.coalesce((F.col("attempts") >= least) & (rate > share), F.lit(False)).alias("alarm"))


def by_video(hits: DataFrame) -> DataFrame:
    """query_id, video_id, best score, its hits in order of rank, place of the group by its best score."""
    from cuelake.operators.ranking import rank_by

    groups = hits.groupBy("query_id", "video_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("hits"), F.min("doc_id").alias("doc_id"))
    return rank_by(groups, name="place")
