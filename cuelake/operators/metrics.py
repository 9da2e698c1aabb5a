"""Retrieval metrics, summaries and costs, in long form: query_id, metric, value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

KS = (3, 5, 10)
# USD per million tokens, tokens per call, USD per rerank call.
INPUT_PRICE = {"mistral": 2.0, "openai": 0.15, "claude": 0.8, "gemini": 0.075}
OUTPUT_PRICE = {"mistral": 6.0, "openai": 0.6, "claude": 4.0, "gemini": 0.3}
EMBED_PRICE = {"local": 0.0, "mistral": 0.1, "openai": 0.02, "gemini": 0.0}
CHARS_PER_TOKEN, SYSTEM_TOKENS, RERANK_PRICE = 4.0, 200.0, 0.0005
REWRITE_TOKENS, HYDE_TOKENS = (60.0, 40.0), (40.0, 60.0)


def judged(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits with `hit` (1 or 0), `first` (whether this is the document's first place) and the query's number of relevant documents."""
    rel = qrels.select("query_id", "doc_id").distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = hits.select("query_id", "doc_id", "rank").join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    first = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    return marked.join(total, "query_id", "left").select("query_id", "doc_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), first.alias("first"), F.coalesce("n_rel", F.lit(0)).alias("n_rel"))


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall@k, precision@k, ndcg@k (binary; repeats count), mrr and map of every query with hits; rounded to six digits."""
    j = judged(hits, qrels)
    so_far = F.sum(F.when(F.col("first"), F.col("hit")).otherwise(0)).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    j = j.withColumn("so_far", so_far)
    hit = F.col("hit") == 1
    aggs = [F.max("n_rel").alias("n_rel"), F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.sum(F.when(hit & F.col("first"), F.col("so_far") / F.col("rank"))).alias("ap")]
    for k in ks:
        near = F.col("rank") <= k
        aggs += [F.count_distinct(F.when(hit & near, F.col("doc_id"))).alias(f"h{k}"), F.sum(F.when(hit & near, 1 / F.log2(F.col("rank") + 1.0))).alias(f"d{k}")]
    q = j.groupBy("query_id").agg(*aggs)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("n_rel") > 0
    value = {"mrr": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), "map": F.when(some, F.coalesce(F.col("ap"), F.lit(0.0)) / F.col("n_rel")).otherwise(0.0)}
    for k in ks:
        value[f"recall@{k}"] = F.when(some, F.col(f"h{k}") / F.col("n_rel")).otherwise(0.0)
        value[f"precision@{k}"] = F.col(f"h{k}") / F.lit(float(k)) if k else F.lit(0.0)
        value[f"ndcg@{k}"] = F.when(some & F.lit(k > 0), F.coalesce(F.col(f"d{k}"), F.lit(0.0)) / ideal(k)).otherwise(0.0)
    pairs = F.map_from_arrays(F.array(*map(F.lit, value)), F.array(*[F.round(v, 6) for v in value.values()]))
    return q.select("query_id", F.explode(pairs).alias("metric", "value"))


def summary(metrics: DataFrame) -> DataFrame:
    """metric, mean, p10, p25 over the queries (interpolated percentiles)."""
    p = lambda x: F.round(F.percentile("value", x), 6)
    return metrics.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), p(0.1).alias("p10"), p(0.25).alias("p25"))


def latency_summary(times: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """times: elapsed. p50, nearest-rank p95, interpolated p95, mean."""
    return times.groupBy(*keys).agg(
        F.percentile("elapsed", 0.5).alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed)").alias("p95_nearest"),
        F.percentile("elapsed", 0.95).alias("p95_linear"), F.avg("elapsed").alias("mean"),
    )


def _price(provider: Column, prices: dict) -> Column:
    out = F.lit(0.0)
    for name, usd in prices.items():
        out = F.when(provider == name, F.lit(usd)).otherwise(out)
    return out


def query_costs(rows: DataFrame, rewrites: int = 0, hyde: int = 0, reranks: int = 0) -> DataFrame:
    """rows: query_id, query, context, answer, llm, embed. Token and USD estimates; unknown providers cost nothing."""
    chars = lambda c: F.coalesce(F.length(c), F.lit(0)) / CHARS_PER_TOKEN
    tokens_in, tokens_out, tokens_embed = SYSTEM_TOKENS + chars("context") + chars("query"), chars("answer"), chars("query")
    pin, pout, pe = (_price(F.col(c), p) / 1e6 for c, p in (("llm", INPUT_PRICE), ("llm", OUTPUT_PRICE), ("embed", EMBED_PRICE)))
    base, embed = tokens_in * pin + tokens_out * pout, tokens_embed * pe
    aux = lambda t, n: (pin * t[0] + pout * t[1]) * n
    total = base + embed + aux(REWRITE_TOKENS, rewrites) + aux(HYDE_TOKENS, hyde) + reranks * RERANK_PRICE
    usd = lambda c, n: F.round(c, 12).alias(n)
    return rows.select(
        "query_id", "llm", F.rint(tokens_in).cast("long").alias("input_tokens"), F.rint(tokens_out).cast("long").alias("output_tokens"), F.rint(tokens_embed).cast("long").alias("embed_tokens"),
        usd(base, "llm_usd"), usd(aux(REWRITE_TOKENS, rewrites), "rewrite_usd"), usd(aux(HYDE_TOKENS, hyde), "hyde_usd"), usd(F.lit(reranks * RERANK_PRICE), "rerank_usd"), usd(embed, "embed_usd"), usd(total, "total_usd"),
    )


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; null if either is blank."""

    def score(a, b):
        a, b = (a or "").lower().split(), (b or "").lower().split()
        if not a or not b:
            return None
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        p, r = row[-1] / len(a), row[-1] / len(b)
        return 2 * p * r / (p + r) if p + r else 0.0

    return pd.Series([score(a, b) for a, b in zip(answer, reference)], dtype="float64")
