"""BM25 (Okapi, with the idf floor) over posting tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import corpus_tokens, query_tokens
from cuelake.operators.ranking import top_k
from cuelake.scratch import left_over, scratch

K1, B, EPSILON = 1.5, 0.75, 0.25


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(corpus_tokens(F.col("text")))).alias("avgdl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df. Each document counts a term once before the shuffle, which then carries sums per term."""
    return docs.select(F.explode(F.array_distinct(corpus_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequencies(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf. Negative values become a share of the mean over the whole vocabulary, negative ones included."""
    raw = frequencies.join(F.broadcast(stats.select("n_docs"))).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row of statistics
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.join(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


class Index(NamedTuple):
    """postings: doc_id, dl, term, tf. terms: term, df, idf. docs: doc_id. floor: the idf of words in over half the documents."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    avgdl: float
    floor: float


def build(docs: DataFrame, path: str | None = None) -> Index:
    """docs: doc_id, text. Tokenises once and writes postings, vocabulary and statistics, for the many searches of a version or (without a path) for one."""
    spark = docs.sparkSession
    if path is None:
        path = left_over(spark, scratch(spark, "words"))
    words = docs.select("doc_id", corpus_tokens(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    words.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{path}/postings")
    docs.select("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    postings = spark.read.parquet(f"{path}/postings")
    n = spark.read.parquet(f"{path}/docs").count()
    postings.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    raw = spark.read.parquet(f"{path}/terms").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    total = postings.agg((F.sum("tf") / F.lit(max(n, 1))).alias("avgdl"))
    floor.crossJoin(total).withColumn("n_docs", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # one row each; written last
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    raw = F.log(stats.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = spark.read.parquet(f"{path}/terms").select("term", "df", F.when(raw < 0, F.lit(stats.floor)).otherwise(raw).alias("idf"))
    return Index(spark.read.parquet(f"{path}/postings"), terms, spark.read.parquet(f"{path}/docs"), stats.avgdl or 1.0, stats.floor or 0.0)


def search(queries: DataFrame, docs: DataFrame | None, k: int, index: Index | None = None) -> DataFrame:
    """queries: query_id, text. query_id, doc_id, score, rank of the k best documents each; documents without a match score 0 and still rank.

    Postings meet the queries' words, so that only matching ones are shuffled; adaptive execution broadcasts the words if
    they are few and splits those that hold many postings if not. Of documents without a match the first by id follow:
    k of them do, unless words in over half the documents count against a document (a negative floor); then as many
    more as a query has documents below zero among the first.
    """
    index = index or build(docs)
    asked = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))
    tf = F.col("tf").cast("double")
    weight = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl)))
    hits = index.postings.join(weights, "term").select("query_id", "doc_id", weight.alias("weight"))
    every = queries.select("query_id").distinct()
    if index.floor >= 0:
        first = F.broadcast(index.docs.orderBy("doc_id").limit(k))  # k rows
    else:
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score")).groupBy("query_id")
        counted = scored.agg(F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") < 0).alias("below"))
        short = every.join(counted, "query_id", "left").where(F.coalesce("above", F.lit(0)) < k)
        most = short.agg(F.max("below")).first()[0] or 0
        every, first = short.select("query_id"), index.docs.orderBy("doc_id").limit(k + most)
    filler = every.join(first).select("query_id", "doc_id", F.lit(0.0).alias("weight"))
    return top_k(hits.unionByName(filler).groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score")), k)
