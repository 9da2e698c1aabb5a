"""Ranks, cuts, filters and orders of hit lists: query_id, doc_id, score, rank and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def rank_by(hits: DataFrame, keys: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """Ranks from one, the best score first, ties by doc_id."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")).cast("int"))


def top_k(hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each list; each task keeps no more than k before the shuffle."""
    return rank_by(hits, keys).where(F.col("rank") <= k)


def overfetch(k: int, hybrid: bool = False, multiplier: int = 3, dated: bool = False, speech_filter: bool = False, related: bool = False, same_video: bool = False) -> int:
    """How many hits to fetch so that k remain after later filters."""
    if related:
        return 3 * k if same_video else k + 1
    n = k * multiplier if hybrid else k
    n = max(n, 3 * k) if dated else n
    return max(n, k * max(3, multiplier)) if speech_filter else n


def threshold(hits: DataFrame, least: float) -> DataFrame:
    """Scores from `least` on; zero keeps everything."""
    return hits if not least else hits.where(F.col("score") >= least)


def date_range(hits: DataFrame, start: Column | None, end: Column | None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Closed range on a date column; undated hits go; ranks are given anew."""
    kept = hits.where(F.col("date").isNotNull())
    kept = kept if start is None else kept.where(F.col("date") >= start)
    kept = kept if end is None else kept.where(F.col("date") <= end)
    return rank_by(kept, keys)


def without_speech_free(hits: DataFrame) -> DataFrame:
    return hits.where(~F.coalesce("is_speech_free", F.lit(False)))


def time_decay(hits: DataFrame, as_of: Column, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores weighted by recency; `rank` stays as it was, `final_rank` is the new one. Undated hits keep their score."""
    age = F.greatest(F.lit(0), F.date_diff(as_of, F.col("date")))
    boost = F.when(F.col("date").isNotNull(), 0.7 + 0.3 / (1 + age / 30.0)).otherwise(1.0).cast("double")
    out = hits.withColumn("time_boost", F.round(boost, 6)).withColumn("original_score", F.col("score")).withColumn("score", F.round(F.col("score") * boost, 6))
    return rank_by(out, keys, "final_rank")


def prompt_order(hits: DataFrame, order: str = "rank", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds `place`: by rank, reversed, or book-ended (the second best last). Anything else is by rank."""
    n = F.count("*").over(W.partitionBy(*keys))
    r = F.col("rank")
    place = {"reversed": n + 1 - r, "book_end": F.when((r == 1) | (n <= 2), r).when(r == 2, n).otherwise(r - 1)}.get(order, r)
    return hits.withColumn("place", place.cast("int"))


def rerank(hits: DataFrame, scorer, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """scorer: a column expression from query and text to a score; without one the first k stay as they are."""
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    return top_k(hits.withColumn("original_score", F.col("score")).withColumn("score", scorer), k, keys)


def stratified(rows: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """About n rows, alike many of each stratum, chosen by hash; topped up from the rest if short."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.lit(max(rows.select(stratum).distinct().count(), 1))))
    ranked = rows.withColumn("__place", place).withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy("__place", "doc_id")))
    return ranked.withColumn("__late", F.col("__r") > quota).orderBy("__late", "__place", "doc_id").limit(n).drop("__place", "__r", "__late")
