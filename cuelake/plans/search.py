"""Queries answered set-at-a-time: every stage is a table keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import bm25, fusion, ranking, vector


def hybrid(questions: DataFrame, embedded: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10, multiplier: int = 3, method: str = "rrf", skip_self: bool = True) -> DataFrame:
    """questions: query_id, text; embedded: query_id, embedding. Words and vectors, fused and cut to k.

    Both lists are fetched k * multiplier deep, as a later filter or fusion may drop rows.
    """
    n = ranking.overfetch(k, hybrid=True, multiplier=multiplier)
    words = bm25.search(questions, docs, n)
    near = vector.knn(embedded, vectors, n, skip_self=skip_self)
    return fusion.rrf(words, near, limit=k) if method == "rrf" else fusion.weighted(near, words, limit=k)


def answer_plan(hits: DataFrame, as_of=None, start=None, end=None, least: float = 0.0, order: str = "rank", k: int = 5) -> DataFrame:
    """After retrieval: speech-free and date filters, recency, threshold, cut and prompt order. hits: query_id, doc_id, score, rank, date, is_speech_free."""
    out = ranking.without_speech_free(hits)
    if start is not None or end is not None:
        out = ranking.date_range(out, start, end)
    if as_of is not None:
        out = ranking.time_decay(out, as_of).drop("rank").withColumnRenamed("final_rank", "rank")
    out = ranking.threshold(out, least).where(F.col("rank") <= k)
    return ranking.prompt_order(out, order)
