"""Experiment conditions as data, and what is made of their per-query results."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HYBRID, FUSION, STAGES, REWRITE, HYDE, RERANK = "hybrid_search.enabled", "hybrid_search.fusion_method", "two_stage.enabled", "two_stage.query_rewrite_enabled", "two_stage.hyde_enabled", "reranker.enabled"
# The sweep's axes, each with its values and the one that holds while another is swept.
AXES = {
    "hyde_alpha": ("two_stage.hyde_alpha", [0.1, 0.3, 0.5, 0.7, 0.9], 0.5), "rewrite_variants": ("two_stage.query_rewrite_variants", [1, 2, 3, 5], 2), "pool_size": ("hybrid_search.top_k_multiplier", [2, 3, 5], 3),
    "merge_strategy": ("two_stage.merge_strategy", ["coverage", "diverse_rrf"], "coverage"), "merge_rrf_k": ("two_stage.merge_rrf_k", [20, 40, 60], 60), "doc_order": ("two_stage.prompt_doc_order", ["rank", "reversed", "book_end"], "rank"),
}
LLMS = ["mistral", "openai", "claude", "gemini"]
EMBEDDERS = {"local": ("intfloat/multilingual-e5-large", 1024), "mistral": ("mistral-embed", 1024), "openai": ("text-embedding-3-large", 3072), "gemini": ("models/text-embedding-004", 3072)}


def ablation() -> list[dict]:
    """Eight conditions, from vectors alone to everything."""
    grid = [("vector_only", None, 0, 0, 0), ("hybrid_rrf", "rrf", 0, 0, 0), ("hybrid_weighted", "weighted", 0, 0, 0), ("hybrid_rrf+rewrite", "rrf", 1, 0, 0), ("hybrid_rrf+hyde", "rrf", 0, 1, 0), ("hybrid_rrf+rewrite+hyde", "rrf", 1, 1, 0), ("hybrid_rrf+reranker", "rrf", 0, 0, 1), ("full_pipeline", "rrf", 1, 1, 1)]
    out = []
    for i, (label, method, rewrite, hyde, rerank) in enumerate(grid, 1):
        changes = {HYBRID: method is not None, STAGES: bool(rewrite or hyde), RERANK: bool(rerank)} | ({FUSION: method} if method else {}) | ({REWRITE: bool(rewrite), HYDE: bool(hyde)} if rewrite or hyde else {})
        out.append({"id": f"{i:02d}", "label": label, "overrides": changes})
    return out


def sweep() -> list[dict]:
    """One axis at a time, the others at their defaults: twenty conditions."""
    base = {HYBRID: True, FUSION: "rrf", STAGES: True, REWRITE: True, HYDE: True, RERANK: False} | {path: default for path, _, default in AXES.values()}
    return [{"id": f"{axis}-{v}".replace(".", "p"), "label": f"{axis}={v}", "axis": axis, "overrides": base | {path: v}} for axis, (path, values, _) in AXES.items() for v in values]


def providers() -> list[dict]:
    """Every language model with every embedder; vectors follow the embedder."""
    pairs = [(llm, e) for llm in LLMS for e in EMBEDDERS]
    return [{"id": f"{i:02d}", "label": f"llm={llm}_emb={e}", "overrides": {"llm.provider": llm, "embedding.provider": e, "embedding.model_name": EMBEDDERS[e][0], "index.vector_size": EMBEDDERS[e][1], f"{llm}.top_k": 5}} for i, (llm, e) in enumerate(pairs, 1)]


def overridden(config: dict, changes: dict) -> dict:
    """A copy of a configuration tree with dotted paths set."""
    out = copy.deepcopy(config)
    for path, value in changes.items():
        node = out
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = value
    return out


def as_table(spark: SparkSession, conditions: list[dict]) -> DataFrame:
    """condition_id, label, path, value: one row per setting."""
    return spark.createDataFrame([(c["id"], c["label"], k, str(v)) for c in conditions for k, v in c["overrides"].items()], "condition_id string, label string, path string, value string")


def condition_summary(results: DataFrame) -> DataFrame:
    """results: condition_id, elapsed_ms, rouge_l, error. Rows with an error count as errors only."""
    good = F.col("error").isNull()
    time = F.when(good, F.col("elapsed_ms"))
    valid = results.withColumn("t", time)
    ranked = valid.withColumn("r", F.row_number().over(W.partitionBy("condition_id").orderBy(F.col("t").asc_nulls_last()))).withColumn("n", F.count("t").over(W.partitionBy("condition_id")))
    return ranked.groupBy("condition_id").agg(
        F.round(F.percentile("t", 0.5), 6).alias("latency_p50"), F.max(F.when(F.col("r") == F.ceil(F.col("n") * 0.95), F.col("t"))).alias("latency_p95"), F.round(F.avg("t"), 6).alias("latency_mean"),
        F.round(F.avg(F.when(good, F.col("rouge_l"))), 6).alias("rouge_l"), F.count_if(good).alias("num_queries"), F.count_if(~good).alias("num_errors"),
    )


def stage_latency(stages: DataFrame) -> DataFrame:
    """stages: condition_id, stage, elapsed. Interpolated p50 and p95 and the mean of each stage; stages that were not measured stay null."""
    return stages.groupBy("condition_id", "stage").agg(F.round(F.percentile("elapsed", 0.5), 6).alias("p50"), F.round(F.percentile("elapsed", 0.95), 6).alias("p95"), F.round(F.avg("elapsed"), 6).alias("mean"))


def bar_points(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """metrics: condition_id, metric, value. Conditions that have both metrics."""
    wide = metrics.where(F.col("metric").isin(first, second)).groupBy("condition_id").pivot("metric", [first, second]).agg(F.first("value"))
    return wide.select("condition_id", F.col(f"`{first}`").alias("first"), F.col(f"`{second}`").alias("second")).where("first is not null and second is not null")


def judge_records(records: DataFrame) -> DataFrame:
    """records: question, answer, contexts, ground_truth. Usable ones: some context must say something; `with_truth` tells whether recall can be judged."""
    said = F.filter("contexts", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    good = records.where(F.col("question").isNotNull() & F.col("answer").isNotNull() & (F.size(said) > 0))
    return good.withColumn("with_truth", F.trim(F.coalesce("ground_truth", F.lit(""))) != "")
