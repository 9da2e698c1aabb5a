"""Benchmark triples: corpus, queries and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, max_docs: int | None = None, max_queries: int | None = None, min_score: int = 1):
    """(corpus, queries, qrels): the corpus capped by doc_id, judgements within it, queries that keep one, capped by query_id, and their judgements."""
    if max_docs is not None:
        corpus = corpus.orderBy("doc_id").limit(max_docs)
    kept = qrels.where(F.col("score") >= min_score).join(corpus.select("doc_id"), "doc_id", "left_semi")
    asked = queries.join(kept.select("query_id").distinct(), "query_id", "left_semi")
    if max_queries is not None:
        asked = asked.orderBy("query_id").limit(max_queries)
    return corpus, asked, kept.join(asked.select("query_id"), "query_id", "left_semi")
