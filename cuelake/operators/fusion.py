"""Fusion of ranked lists and merging of query variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelake.operators.ranking import rank_by

RRF_K, BM25_WEIGHT, ABSENT = 60, 0.3, 0.1


def rrf(*lists: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; one shuffle, whatever their number."""
    every = reduce(DataFrame.union, [x.select("query_id", "doc_id", "rank") for x in lists])
    fused = rank_by(every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")))
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def _scaled(hits: DataFrame, name: str) -> DataFrame:
    """Scores from 0 to 1 within each list; without any range all are 1."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.select("query_id", "doc_id", F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(1.0).alias(name))


def weighted(vectors: DataFrame, words: DataFrame, weight: float = BM25_WEIGHT, absent: float = ABSENT, limit: int | None = None) -> DataFrame:
    """(1 - weight) * vector score + weight * word score, each scaled; a document absent from a list gets `absent`."""
    both = _scaled(vectors, "v").join(_scaled(words, "w"), ["query_id", "doc_id"], "full_outer")
    score = (1 - weight) * F.coalesce("v", F.lit(absent)) + weight * F.coalesce("w", F.lit(absent))
    fused = rank_by(both.select("query_id", "doc_id", F.round(score, 6).alias("score")))
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def diverse_rrf(variants: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """variants: query_id, variant, doc_id, rank. Reciprocal ranks weighted by one over the root of the variants that found the document."""
    weight = 1 / F.sqrt(F.count("*").over(W.partitionBy("query_id", "doc_id")))
    fused = variants.withColumn("__w", weight).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("__w") / (k + F.col("rank"))), 9).alias("score"))
    fused = rank_by(fused)
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def coverage(variants: DataFrame, k: int) -> DataFrame:
    """variants: query_id, variant (0 to 62), doc_id, score. Greedy choice of k documents: most variants not yet covered, then best score, then doc_id."""
    bit = F.expr("shiftleft(1L, cast(variant AS INT))")
    docs = variants.groupBy("query_id", "doc_id").agg(F.bit_or(bit).alias("mask"), F.max("score").alias("score"))
    # A query's candidates are its variants' lists: as many as the retrieval limit allows.
    lists = docs.groupBy("query_id").agg(F.collect_list(F.struct("mask", "score", "doc_id")).alias("rest"))
    kind = dict(lists.dtypes)["rest"]
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.expr(f"cast(array() as {kind})").alias("picked"), F.col("rest"))

    def step(s, _):
        best = F.array_min(F.transform(s["rest"], lambda x: F.struct((-F.bit_count(x["mask"].bitwiseAND(F.bitwise_not(s["covered"])))).alias("gain"), (-x["score"]).alias("down"), x["doc_id"].alias("doc_id"), x["mask"].alias("mask"), x["score"].alias("score"))))
        taken = F.struct(best["mask"].alias("mask"), best["score"].alias("score"), best["doc_id"].alias("doc_id"))
        return F.when(F.size(s["rest"]) == 0, s).otherwise(F.struct(s["covered"].bitwiseOR(best["mask"]).alias("covered"), F.concat(s["picked"], F.array(taken)).alias("picked"), F.filter(s["rest"], lambda x: x["doc_id"] != best["doc_id"]).alias("rest")))

    chosen = lists.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["picked"].alias("picked"))
    return chosen.select("query_id", F.posexplode("picked").alias("i", "p")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "p.doc_id", "p.score")


def intent_coverage(variants: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of a query's variants with a relevant document among their first k."""
    hit = variants.join(qrels.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    each = hit.groupBy("query_id", "variant").agg(F.max(F.when(F.col("rank") <= k, F.coalesce("hit", F.lit(0))).otherwise(0)).alias("any"))
    return each.groupBy("query_id").agg(F.round(F.avg("any"), 6).alias("intent_coverage"))
