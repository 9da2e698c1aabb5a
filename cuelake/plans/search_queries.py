"""Queries on retrieval, fusion, merging, ranking, prompts, metrics and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import bm25, fusion, metrics, ranking, vector
from cuelake.operators import metadata as M
from cuelake.plans.text_queries import META, articles
from cuelake.registry import query, table

AS_OF = "2024-02-01"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark, sf_dir):
    """Every benchmark item, in full."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


POSTINGS = r"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+')) AS term FROM documents) GROUP BY ALL"
LENGTHS = r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+')) AS dl FROM documents"
BM25 = rf"""post AS ({POSTINGS}), lens AS ({LENGTHS}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
mean AS (SELECT avg(raw) AS m FROM raw), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mean),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
every AS (SELECT item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = item_id AND h.doc_id = d.doc_id),
bm AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM every)"""


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, sf_dir):
    d = docs(spark, sf_dir)
    return bm25.inverse_frequencies(bm25.document_frequencies(d), bm25.corpus_stats(d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 10)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE query_id = 3 AND rank <= 700")
def bm25_zero_scores(spark, sf_dir):
    """A list longer than the matches: documents without a match still rank."""
    return bm25.search(questions(spark, sf_dir).where("query_id = 3"), docs(spark, sf_dir), 700)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("video_id"))


#: The stated queries of searches: every row whose id is divisible by 100.
HUNDREDTH = "doc_id % 100 = 0"


def _knn(name, expr, metric):
    sql = f"""WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, round({expr}, 6) AS score FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""

    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        return vector.knn(v.where(HUNDREDTH).withColumnRenamed("doc_id", "query_id"), v, 10, metric, skip_self=True)

    run.__name__ = name
    query(sql)(run)


Q, D = "CAST(q.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
_knn("knn_cosine", f"list_cosine_similarity({Q}, {D})", "cosine")
_knn("knn_dot", f"list_inner_product({Q}, {D})", "dot")
_knn("knn_euclid", f"-list_distance({Q}, {D})", "euclid")

def _nearest(condition):
    return f"""kn AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity({Q}, {D}), 6) AS score FROM embeddings q, embeddings b WHERE {condition} AND b.vec_id <> q.vec_id))"""


KNN, KNN_ITEMS = _nearest("q.vec_id % 100 = 0"), _nearest("q.vec_id IN (SELECT item_id FROM benchmark)")


def near(spark, sf_dir, k, chosen=HUNDREDTH):
    v = vectors(spark, sf_dir)
    return vector.knn(v.where(chosen).withColumnRenamed("doc_id", "query_id"), v, k, skip_self=True)


def embedded(spark, sf_dir):
    """A vector for each benchmark item: the one of the same number."""
    return questions(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "embedding"), "query_id")


def near_items(spark, sf_dir, k):
    return vector.knn(embedded(spark, sf_dir), vectors(spark, sf_dir), k, skip_self=True)


@query("""SELECT CAST(5 AS BIGINT) AS query_id, doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT b.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings b WHERE q.vec_id = 5 AND b.vec_id <> 5) QUALIFY rank <= 8""")
def related_chunks(spark, sf_dir):
    return vector.related(vectors(spark, sf_dir), 5, 8)


@query("""SELECT CAST(5 AS BIGINT) AS query_id, doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT b.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings b WHERE q.vec_id = 5 AND b.vec_id <> 5 AND b.label = q.label) QUALIFY rank <= 8""")
def related_same_video(spark, sf_dir):
    return vector.related(vectors(spark, sf_dir), 5, 8, same_video=True)


@query("""SELECT vec_id, round(x[1] / n, 6) AS first, round(x[64] / n, 6) AS last, round(sqrt(list_sum(list_transform(x, lambda v: v / n * v / n))), 6) AS length FROM (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM
(SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * 0.7 + CAST(p[2] AS DOUBLE) * 0.3) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))""")
def hyde_blend(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    d = pairs.select("vec_id", vector.blend(F.col("embedding"), F.col("other"), 0.3).alias("x"))
    return d.select("vec_id", F.round(F.col("x")[0], 6).alias("first"), F.round(F.col("x")[63], 6).alias("last"), F.round(vector.norm(F.col("x")), 6).alias("length"))


HYBRID = f"WITH {BM25}, {KNN_ITEMS}"


@query(f"{HYBRID}, u AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM kn WHERE rank <= 20), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10")
def hybrid_search(spark, sf_dir):
    """The flagship: each benchmark item as a text query over the documents (BM25) fused with the nearest vectors (one vector stands for each query)."""
    from cuelake.plans.search import hybrid

    return hybrid(questions(spark, sf_dir), embedded(spark, sf_dir), docs(spark, sf_dir), vectors(spark, sf_dir), k=10, multiplier=2)


@query(f"{HYBRID}, a AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS v FROM kn WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS w FROM bm WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(0.7::DOUBLE * coalesce(v, 0.1) + 0.3 * coalesce(w, 0.1), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * coalesce(v, 0.1) + 0.3 * coalesce(w, 0.1), 6) DESC, doc_id) AS INTEGER) AS rank FROM a FULL JOIN b USING (query_id, doc_id)")
def weighted_fusion(spark, sf_dir):
    return fusion.weighted(near_items(spark, sf_dir, 20), bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 20))


@query(f"{HYBRID} SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM kn WHERE rank <= 10) GROUP BY query_id, doc_id")
def rrf_fusion(spark, sf_dir):
    """All fused rows, not cut to k."""
    return fusion.rrf(bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 10), near_items(spark, sf_dir, 10))


VARIANTS = f"""WITH {_nearest("q.vec_id % 100 < 3")}, va AS (SELECT query_id - query_id % 100 AS query_id, query_id % 100 AS variant, doc_id, score, rank FROM kn WHERE rank <= 15)"""


def variants(spark, sf_dir, k=15):
    """Three vectors a query: every vector whose id is divisible by 100, and the two after it."""
    n, v = near(spark, sf_dir, k, "doc_id % 100 < 3"), F.col("query_id") % 100
    return n.select((F.col("query_id") - v).alias("query_id"), v.alias("variant"), "doc_id", "score", "rank")


@query(f"{VARIANTS}, c AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM va) SELECT query_id, doc_id, round(sum(1 / sqrt(n) / (60 + rank)), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / sqrt(n) / (60 + rank)), 9) DESC, doc_id) AS INTEGER) AS rank FROM c GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / sqrt(n) / (60 + rank)), 9) DESC, doc_id) <= 12")
def diverse_rrf_merge(spark, sf_dir):
    return fusion.diverse_rrf(variants(spark, sf_dir), limit=12)


@query(
    f"""WITH RECURSIVE {VARIANTS[5:]}, d AS (SELECT query_id, doc_id, bit_or(CAST(1 << variant AS BIGINT)) AS mask, max(score) AS score FROM va GROUP BY ALL),
g(query_id, rank, covered, picked, doc_id, score) AS (SELECT DISTINCT query_id, 0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM d UNION ALL
SELECT query_id, rank + 1, covered | mask, list_append(picked, doc_id), doc_id, score FROM (SELECT g.query_id, g.rank, g.covered, g.picked, d.doc_id, d.score, d.mask, row_number() OVER (PARTITION BY g.query_id ORDER BY bit_count(d.mask & ~g.covered) DESC, d.score DESC, d.doc_id) AS place
FROM g JOIN d ON d.query_id = g.query_id AND NOT list_contains(g.picked, d.doc_id) WHERE g.rank < 6) WHERE place = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM g WHERE rank > 0"""
)
def coverage_merge(spark, sf_dir):
    return fusion.coverage(variants(spark, sf_dir), 6)


@query(f"{VARIANTS}, qr AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, round(avg(h), 6) AS intent_coverage FROM (SELECT va.query_id, variant, max(CASE WHEN qr.doc_id IS NOT NULL AND rank <= 5 THEN 1 ELSE 0 END) AS h FROM va LEFT JOIN qr USING (query_id, doc_id) GROUP BY ALL) GROUP BY query_id")
def intent_coverage(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return fusion.intent_coverage(variants(spark, sf_dir), label_qrels(v), 5)


def label_qrels(v):
    """Vectors with the query's label are relevant."""
    q = v.where(HUNDREDTH).select(F.col("doc_id").alias("query_id"), "video_id")
    return q.join(v.select("doc_id", "video_id"), "video_id").where("query_id <> doc_id").select("query_id", "doc_id")


DATED = f"{HYBRID}, da AS (SELECT query_id, doc_id, score, rank, CASE WHEN doc_id % 9 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 45 AS INTEGER) AS DATE) END AS date, doc_id % 11 = 0 AS is_speech_free FROM bm WHERE rank <= 30)"


def dated(spark, sf_dir):
    hits = bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 30)
    date = F.when(F.col("doc_id") % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 45).cast("int")))
    return hits.withColumn("date", date).withColumn("is_speech_free", F.col("doc_id") % 11 == 0)


BOOST = f"round(CASE WHEN date IS NULL THEN 1.0 ELSE 0.7 + 0.3 / (1 + greatest(0, date_diff('day', date, DATE '{AS_OF}')) / 30.0) END::DOUBLE, 6)"


@query(f"{DATED} SELECT query_id, doc_id, rank, {BOOST} AS time_boost, round(score * CASE WHEN date IS NULL THEN 1.0 ELSE 0.7 + 0.3 / (1 + greatest(0, date_diff('day', date, DATE '{AS_OF}')) / 30.0) END::DOUBLE, 6) AS new_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, doc_id) AS INTEGER) AS final_rank FROM da")
def time_decay(spark, sf_dir):
    d = ranking.time_decay(dated(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return d.select("query_id", "doc_id", "rank", "time_boost", F.col("score").alias("new_score"), "final_rank")


@query(f"{DATED} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM da WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-02-05' AND NOT is_speech_free QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def date_filter_post(spark, sf_dir):
    d = ranking.without_speech_free(dated(spark, sf_dir))
    out = ranking.date_range(d, F.lit("2024-01-10").cast("date"), F.lit("2024-02-05").cast("date"))
    return out.where("rank <= 10").select("query_id", "doc_id", "score", "rank")


@query(f"WITH {KNN} SELECT query_id, doc_id, score FROM kn WHERE rank <= 10 AND score >= 0.3")
def score_threshold(spark, sf_dir):
    return ranking.threshold(near(spark, sf_dir, 10), 0.3).select("query_id", "doc_id", "score")


@query(f"WITH {KNN}, t AS (SELECT query_id, doc_id, rank, count(*) OVER (PARTITION BY query_id) AS n FROM kn WHERE rank <= 5) SELECT query_id, doc_id, CAST(n + 1 - rank AS INTEGER) AS reversed, CAST(CASE WHEN rank = 1 OR n <= 2 THEN rank WHEN rank = 2 THEN n ELSE rank - 1 END AS INTEGER) AS book_end FROM t")
def prompt_orders(spark, sf_dir):
    n = near(spark, sf_dir, 5)
    a = ranking.prompt_order(n, "reversed").withColumnRenamed("place", "reversed")
    return ranking.prompt_order(a, "book_end").select("query_id", "doc_id", "reversed", F.col("place").alias("book_end"))


@query(f"{DATED} SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context FROM (SELECT query_id, rank, concat('[Document ', rank, ']', CASE WHEN is_speech_free THEN ' [No transcript — description only]' ELSE concat(' [Chunk ', doc_id % 4 + 1, '/4]') END, chr(10), CASE WHEN date IS NOT NULL THEN concat('Date: ', strftime(date, '%Y-%m-%d'), chr(10)) ELSE '' END, 'Duration: ', (doc_id % 500 + 30) // 60, ':', printf('%02d', CAST((doc_id % 500 + 30) % 60 AS BIGINT)), chr(10), CASE WHEN NOT is_speech_free THEN concat('Timecodes: 00:00:01 - 00:01:00', chr(10)) ELSE '' END, CASE WHEN is_speech_free THEN 'Description: ' ELSE 'Text: ' END, CASE WHEN length(text) > 2000 THEN concat(regexp_replace(substr(text, 1, 2000), '\\s+$', ''), '...') ELSE text END, chr(10)) AS block FROM da JOIN documents USING (doc_id) WHERE rank <= 3) GROUP BY query_id")
def prompt_context(spark, sf_dir):
    from cuelake.operators.prompt import context

    hits = dated(spark, sf_dir).where("rank <= 3").join(docs(spark, sf_dir), "doc_id")
    rows = hits.select("query_id", "rank", "text", F.date_format("date", "yyyy-MM-dd").alias("date"), (F.col("doc_id") % 500 + 30).cast("double").alias("duration_seconds"), "is_speech_free", F.lit(True).alias("is_chunk"), (F.col("doc_id") % 4).cast("int").alias("chunk_index"), F.lit(4).alias("total_chunks"), F.lit("00:00:01").alias("start_time"), F.lit("00:01:00").alias("end_time"))
    return context(rows)


METRIC_SQL = f"""WITH {KNN}, h AS (SELECT * FROM kn WHERE rank <= 10), qr AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
tot AS (SELECT query_id, count(*) AS n FROM qr GROUP BY query_id), j AS (SELECT h.query_id, h.rank, CASE WHEN qr.doc_id IS NULL THEN 0 ELSE 1 END AS hit, coalesce(n, 0) AS n FROM h LEFT JOIN qr USING (query_id, doc_id) LEFT JOIN tot ON tot.query_id = h.query_id),
c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM j), ks AS (SELECT unnest([3, 5, 10]) AS k),
m AS (SELECT query_id, 'mrr' AS metric, coalesce(1.0 / min(rank) FILTER (WHERE hit = 1), 0)::DOUBLE AS value FROM c GROUP BY query_id UNION ALL
SELECT query_id, 'map', CASE WHEN max(n) > 0 THEN coalesce(sum(so_far / rank) FILTER (WHERE hit = 1), 0) / max(n) ELSE 0 END FROM c GROUP BY query_id UNION ALL
SELECT query_id, concat('recall@', k), CASE WHEN max(n) > 0 THEN sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / max(n) ELSE 0 END FROM c, ks GROUP BY query_id, k UNION ALL
SELECT query_id, concat('precision@', k), sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / k FROM c, ks GROUP BY query_id, k UNION ALL
SELECT query_id, concat('ndcg@', k), CASE WHEN max(n) > 0 THEN sum(CASE WHEN rank <= k THEN hit / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(generate_series(1, least(max(n), k)), lambda i: 1 / log2(i + 1))) ELSE 0 END FROM c, ks GROUP BY query_id, k)"""


@query(f"{METRIC_SQL} SELECT query_id, metric, round(value, 6) AS value FROM m")
def retrieval_metrics(spark, sf_dir):
    return metrics.retrieval_metrics(near(spark, sf_dir, 10), label_qrels(vectors(spark, sf_dir)))


@query(f"{METRIC_SQL} SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25 FROM (SELECT metric, round(value, 6) AS v FROM m) GROUP BY metric")
def metric_summary(spark, sf_dir):
    return metrics.summary(metrics.retrieval_metrics(near(spark, sf_dir, 10), label_qrels(vectors(spark, sf_dir))))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.95) AS p95_nearest, round(quantile_cont(value, 0.95), 6) AS p95_linear, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_type", F.col("value").alias("elapsed"))
    return metrics.latency_summary(e, ("event_type",)).select("event_type", F.round("p50", 6).alias("p50"), "p95_nearest", F.round("p95_linear", 6).alias("p95_linear"), F.round("mean", 6).alias("mean"))


PAIRS = "SELECT q.conv_id * 100 + q.turn AS query_id, q.text AS query, a.text AS answer, CASE q.conv_id % 5 WHEN 0 THEN 'mistral' WHEN 1 THEN 'openai' WHEN 2 THEN 'claude' WHEN 3 THEN 'gemini' ELSE 'none' END AS llm, CASE q.conv_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'mistral' ELSE 'openai' END AS embed FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"
PRICED = f"SELECT *, CASE llm WHEN 'mistral' THEN 2.0 WHEN 'openai' THEN 0.15 WHEN 'claude' THEN 0.8 WHEN 'gemini' THEN 0.075 ELSE 0.0 END::DOUBLE / 1e6 AS pi, CASE llm WHEN 'mistral' THEN 6.0 WHEN 'openai' THEN 0.6 WHEN 'claude' THEN 4.0 WHEN 'gemini' THEN 0.3 ELSE 0.0 END::DOUBLE / 1e6 AS po, CASE embed WHEN 'mistral' THEN 0.1 WHEN 'openai' THEN 0.02 ELSE 0.0 END::DOUBLE / 1e6 AS pe, 200 + length(query) / 4.0::DOUBLE + length(query) / 4.0::DOUBLE AS ti, length(answer) / 4.0::DOUBLE AS tt, length(query) / 4.0::DOUBLE AS te FROM ({PAIRS})"
COSTS = f"SELECT query_id, llm, CAST(round_even(ti, 0) AS BIGINT) AS input_tokens, CAST(round_even(tt, 0) AS BIGINT) AS output_tokens, CAST(round_even(te, 0) AS BIGINT) AS embed_tokens, round(ti * pi + tt * po, 12) AS llm_usd, round(pi * 60 + po * 40, 12) AS rewrite_usd, round(pi * 40 + po * 60, 12) AS hyde_usd, 0.0005::DOUBLE AS rerank_usd, round(te * pe, 12) AS embed_usd, round(ti * pi + tt * po + te * pe + pi * 100 + po * 100 + 0.0005, 12) AS total_usd FROM ({PRICED})"


def answered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("query"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("answer"))
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("conv_id") % n + 1).cast("int"))
    return q.join(a, ["conv_id", "t"]).select((F.col("conv_id") * 100 + F.col("t")).alias("query_id"), "query", "answer", F.col("query").alias("context"), pick(5, "mistral", "openai", "claude", "gemini", "none").alias("llm"), pick(3, "local", "mistral", "openai").alias("embed"))


@query(COSTS)
def query_cost(spark, sf_dir):
    return metrics.query_costs(answered(spark, sf_dir), 1, 1, 1)


@query(f"SELECT llm, CAST(count(*) AS BIGINT) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(total_usd), 6) AS total_usd, round(avg(total_usd), 8) AS mean_usd FROM ({COSTS}) GROUP BY llm")
def cost_aggregate(spark, sf_dir):
    c = metrics.query_costs(answered(spark, sf_dir), 1, 1, 1)
    return c.groupBy("llm").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("total_usd"), 6).alias("total_usd"), F.round(F.avg("total_usd"), 8).alias("mean_usd"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (SELECT source AS query_id, l.doc_id FROM labels l JOIN (SELECT * FROM documents ORDER BY doc_id LIMIT 300) d ON d.doc_id = l.doc_id WHERE quality >= 1 AND source IN (SELECT source FROM documents GROUP BY source ORDER BY source LIMIT 10))")
def beir_filtering(spark, sf_dir):
    """Capped corpus; judgements within it; queries with a judgement, capped."""
    from cuelake.sources.beir import restrict

    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    q = d.select(F.col("source").alias("query_id")).distinct()
    qrels = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("source").alias("query_id"), "doc_id", F.col("quality").alias("score"))
    _, _, kept = restrict(d.select("doc_id"), q, qrels, max_docs=300, max_queries=10, min_score=1)
    return kept.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("doc_id").alias("n_docs"))


@query("""WITH d AS (SELECT doc_id, source, md5(concat('13:', doc_id)) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) > greatest(1, floor(100 / (SELECT count(DISTINCT source) FROM documents))) AS late FROM d)
SELECT doc_id, source FROM r ORDER BY late, h, doc_id LIMIT 100""")
def stratified_sample(spark, sf_dir):
    """By hash instead of a random generator."""
    return ranking.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 100, 13)


@query(f"""WITH hits AS (SELECT doc_id, concat('h', doc_id) AS video_hash, CASE WHEN doc_id % 3 = 0 THEN 'own' END AS web_title, '2020-01-01' AS date FROM documents)
SELECT doc_id, coalesce(h.web_title, m.web_title) AS web_title, CASE WHEN h.web_title IS NULL AND m.video_hash IS NOT NULL THEN coalesce(m.web_date, date) ELSE date END AS date, h.web_title IS NULL AND m.video_hash IS NOT NULL AS enriched FROM hits h LEFT JOIN ({META}) m USING (video_hash)""")
def metadata_enrichment(spark, sf_dir):
    from cuelake.functions.web import basic_unescape, clean_metadata

    none = F.lit(None).cast("string")
    hits = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("video_hash"), F.when(F.col("doc_id") % 3 == 0, "own").alias("web_title"), none.alias("web_date"), F.lit(None).cast("double").alias("web_date_ts"), none.alias("web_description"), none.alias("web_url"), F.lit("2020-01-01").alias("date"))
    return M.enrich(hits, clean_metadata(articles(spark, sf_dir), basic_unescape)).select("doc_id", "web_title", "date", "enriched")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'local' WHEN doc_id % 3 = 0 THEN 'api' END AS value, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 END AS INTEGER) AS matched_by FROM documents")
def fallback_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return M.first_source(d, d.where("doc_id % 4 = 0").withColumn("value", F.lit("local")), d.where("doc_id % 3 = 0").withColumn("value", F.lit("api")), on="doc_id")


@query("SELECT doc_id AS video, concat('v', doc_id, CASE doc_id % 4 WHEN 0 THEN '_720p.mp4' WHEN 1 THEN '_480p.mp4' WHEN 2 THEN '.mp4' ELSE '-cut.webm' END) AS name FROM documents")
def media_choice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video"))
    k = F.col("doc_id") % 4
    have = F.when(k == 0, F.array(*map(F.lit, ["-cut.webm", "_180p.mp4", "_720p.mp4", ".mp4"]))).when(k == 1, F.array(*map(F.lit, [".mp4", "_480p.mp4"]))).when(k == 2, F.array(*map(F.lit, ["-cut.webm", ".mp4"]))).otherwise(F.array(F.lit("-cut.webm")))
    files = d.select("doc_id", "video", F.explode(have).alias("tail")).select("doc_id", "video", F.concat("video", "tail").alias("name"))
    return M.best_media(files).join(d, "video").select(F.col("doc_id").alias("video"), "name")


@query("SELECT source AS video_hash, min(CASE WHEN lang = 'de' THEN concat(lang, doc_id) END) AS ru, min(CASE WHEN lang = 'en' THEN concat(lang, doc_id) END) AS en FROM documents GROUP BY source")
def language_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("video_hash"), F.when(F.col("lang") == "de", "ru").when(F.col("lang") == "en", "en").alias("language"), F.concat("lang", F.col("doc_id").cast("string")).alias("path"))
    return M.split_languages(files)


WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query(f"""WITH {BM25}, s AS (SELECT query_id, bm.doc_id, round(len(list_intersect(qt, dt)) / len(qt), 6) AS score FROM bm JOIN (SELECT item_id, {WORDS} AS qt FROM benchmark) ON item_id = query_id JOIN (SELECT doc_id, {WORDS} AS dt FROM documents) d ON d.doc_id = bm.doc_id WHERE bm.rank <= 5)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3""")
def rerank_overlap(spark, sf_dir):
    """The first five by words, ordered anew by the share of the question's words."""
    from cuelake.operators import models

    hits = bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 5).join(docs(spark, sf_dir), "doc_id").join(questions(spark, sf_dir).select("query_id", F.col("text").alias("query")), "query_id")
    return ranking.rerank(hits, models.overlap(F.col("query"), F.col("text")), 3).select("query_id", "doc_id", "score", "rank")


@query()
def model_stand_ins(spark, sf_dir):
    """Embedding, answer and rerank interfaces with their deterministic stand-ins, and ROUGE-L of the answers."""
    from cuelake.operators import models

    hits = bm25.search(questions(spark, sf_dir), docs(spark, sf_dir), 5).join(docs(spark, sf_dir), "doc_id").join(questions(spark, sf_dir).select("query_id", F.col("text").alias("query")), "query_id")
    again = ranking.rerank(hits, models.overlap(F.col("query"), F.col("text")), 3)
    answers = again.select("query_id", "doc_id", "rank", models.extract_answer(F.col("query"), F.col("text")).alias("answer"), models.embed(F.col("text")).alias("embedding"), "query")
    return answers.select("query_id", "doc_id", "rank", "answer", F.size("embedding").alias("dimension"), F.round(metrics.rouge_l(F.col("answer"), F.col("query")), 6).alias("rouge_l"))
