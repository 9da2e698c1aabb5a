"""Queries on experiments, media and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators import experiments as E
from cuelake.operators import metadata as M
from cuelake.plans.text_queries import PATHS, paths
from cuelake.registry import query, table
from cuelake.sources import vtt as V

RESULTS = "SELECT concat('c', event_id % 8) AS condition_id, value AS elapsed_ms, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0::DOUBLE END AS rouge_l, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events WHERE value IS NOT NULL"


def results(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    i = F.col("event_id")
    return e.select(F.concat(F.lit("c"), (i % 8).cast("string")).alias("condition_id"), F.col("value").alias("elapsed_ms"), F.when(i % 3 == 0, (i % 10) / 10.0).alias("rouge_l"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query(f"SELECT condition_id, round(quantile_cont(elapsed_ms, 0.5) FILTER (WHERE error IS NULL), 6) AS latency_p50, quantile_disc(elapsed_ms, 0.95) FILTER (WHERE error IS NULL) AS latency_p95, round(avg(elapsed_ms) FILTER (WHERE error IS NULL), 6) AS latency_mean, round(avg(rouge_l) FILTER (WHERE error IS NULL), 6) AS rouge_l, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS num_queries, CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS num_errors FROM ({RESULTS}) GROUP BY condition_id")
def condition_summary(spark, sf_dir):
    return E.condition_summary(results(spark, sf_dir))


@query(f"SELECT condition_id, CASE WHEN error IS NULL THEN 'total' ELSE 'failed' END AS stage, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95, round(avg(elapsed_ms), 6) AS mean FROM ({RESULTS}) GROUP BY ALL")
def stage_latency(spark, sf_dir):
    return E.stage_latency(results(spark, sf_dir).select("condition_id", F.when(F.col("error").isNull(), "total").otherwise("failed").alias("stage"), F.col("elapsed_ms").alias("elapsed")))


@query(f"SELECT condition_id, max(elapsed_ms) AS first, max(rouge_l) AS second FROM ({RESULTS}) WHERE condition_id <> 'c3' GROUP BY condition_id HAVING max(rouge_l) IS NOT NULL")
def chart_points(spark, sf_dir):
    r = results(spark, sf_dir)
    long = r.groupBy("condition_id").agg(F.max("elapsed_ms").alias("value")).withColumn("metric", F.lit("recall@5")).unionByName(r.where("condition_id <> 'c3'").groupBy("condition_id").agg(F.max("rouge_l").alias("value")).withColumn("metric", F.lit("ndcg@5")))
    return E.bar_points(long, "recall@5", "ndcg@5")


@query("SELECT CAST(8 AS BIGINT) AS ablation, CAST(20 AS BIGINT) AS sweep, CAST(16 AS BIGINT) AS providers, CAST(6 AS BIGINT) AS axes")
def experiment_conditions(spark, sf_dir):
    n = lambda c: F.lit(E.as_table(spark, c).select("condition_id").distinct().count()).cast("long")
    return spark.range(1).select(n(E.ablation()).alias("ablation"), n(E.sweep()).alias("sweep"), n(E.providers()).alias("providers"), F.lit(len(E.AXES)).cast("long").alias("axes"))


@query("SELECT CAST(count(*) AS BIGINT) AS usable, CAST(count(*) FILTER (WHERE conv_id % 2 = 0) AS BIGINT) AS with_truth FROM conversations WHERE conv_id % 5 <> 0")
def judge_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    context = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array("text"))
    r = E.judge_records(c.select(F.lit("q").alias("question"), F.coalesce("text", F.lit("")).alias("answer"), context.alias("contexts"), F.when(F.col("conv_id") % 2 == 0, "truth").otherwise(" ").alias("ground_truth")))
    return r.agg(F.count("*").alias("usable"), F.count_if("with_truth").alias("with_truth"))


@query("SELECT CAST(doc_id AS VARCHAR) AS video_hash FROM documents WHERE doc_id % 3 = 2")
def missing_captions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", i.alias("video_hash"))
    files = d.where("doc_id % 3 <> 2").select(F.concat(F.lit("/a/"), "video_hash", F.when(F.col("doc_id") % 3 == 0, "_en.vtt").otherwise(".en.vtt")).alias("path")).union(d.select(F.concat(F.lit("/a/"), "video_hash", F.lit(".ru.vtt"))))
    return M.missing_files(d.union(d), files)


@query("SELECT CAST(doc_id AS VARCHAR) AS video_hash, concat('/a/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '_en.vtt' ELSE '.en.vtt' END) AS path FROM documents")
def english_captions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents")
    return M.english_file(d.select(F.concat(F.lit("/a/"), i, F.lit(".en.vtt")).alias("path")).union(d.where("doc_id % 2 = 0").select(F.concat(F.lit("/a/"), i, F.lit("_en.vtt")))))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('x/', doc_id, '.mp4') WHEN 1 THEN concat('y/', doc_id, '.mp4') WHEN 2 THEN concat(array_to_string(regexp_extract_all(sha1(CAST(doc_id AS VARCHAR)), '..'), '/'), '/', sha1(CAST(doc_id AS VARCHAR)), '_720p.mp4') END AS relative FROM documents")
def media_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("i"), F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/data/media/x/"), "i", F.lit(".mp4"))).when(k == 1, F.concat(F.lit("/old/media/y/"), "i", F.lit(".mp4"))).when(k == 2, F.concat(F.lit("/gone/"), "h", F.lit("_720p.mp4"))).otherwise(F.concat(F.lit("/gone/"), "i"))
    files = d.select(F.when(k == 1, F.concat(F.lit("y/"), "i", F.lit(".mp4"))).when(k == 2, F.concat(F.regexp_replace("h", "(..)", "$1/"), "h", F.lit("_720p.mp4"))).alias("relative")).where("relative is not null")
    return M.media_relative(d.select("doc_id", path.alias("path")), files, "/data/media").select("doc_id", "relative")


@query("SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS cell FROM documents GROUP BY source")
def sheet_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("row"), F.col("lang").alias("video_hash"))
    return M.sheet_cells(d).withColumnRenamed("row", "source")


@query(f"SELECT doc_id, split_part(path, '/', 4) AS filename, regexp_replace(regexp_replace(split_part(path, '/', 4), '\\.vtt$', ''), '\\.(en|ru)$', '') AS group_id FROM ({PATHS})")
def session_response(spark, sf_dir):
    return M.response_chunks(paths(spark, sf_dir).select("doc_id", "path"), archive=False)


@query("SELECT key, CASE WHEN bool_or(page_id % 2 = 0) THEN 'local' ELSE 'remote' END AS origin, coalesce(min(url) FILTER (WHERE page_id % 2 = 0), min(url)) AS url FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url ELSE concat('h', page_id % 50) END AS key FROM pages) GROUP BY key")
def union_first_wins(spark, sf_dir):
    """Pages without a hash count by their URL."""
    hashed = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("page_id") % 50).cast("string")))
    p = table(spark, sf_dir, "pages").select("page_id", hashed.alias("video_hash"), "url")
    local, remote = p.where("page_id % 2 = 0").withColumn("origin", F.lit("local")), p.withColumn("origin", F.lit("remote"))
    return M.union_first(local, remote).select(F.coalesce(F.nullif("video_hash", F.lit("")), "url").alias("key"), "origin", "url")


@query("SELECT source AS path, (min(doc_id) + 2.0 * min(doc_id)) / 2.0 AS center FROM documents GROUP BY source")
def silence_centers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.min("doc_id").cast("double").alias("s"))
    marks = d.select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), v.alias("seconds")) for i, (k, v) in enumerate([("end", F.lit(-1.0)), ("start", F.lit(-5.0)), ("start", F.col("s")), ("end", 2 * F.col("s")), ("end", 3 * F.col("s")), ("start", 4 * F.col("s"))])])).alias("m"))
    return M.silence_centers(marks.select("path", "m.*"))


@query("SELECT doc_id, doc_id + 10.0::DOUBLE AS start_s, doc_id + 12.5::DOUBLE AS end_s, 'said' AS text FROM documents")
def transcription_segments(spark, sf_dir):
    seg = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), F.lit(t).alias("text"))
    i = F.col("doc_id").cast("double")
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(seg(i, i + 2.5, " said "), seg(i, i + 1, "  "), seg(i, i, "none")).alias("segments"))
    return V.segments_to_cues(d, F.lit(10.0))


@query("SELECT doc_id, concat('passage: ', trim(concat(source, ' ', lang))) AS passage FROM documents")
def passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.prefixed(F.col("source"), F.col("lang"), model="multilingual-e5-large").alias("passage"))


@query("SELECT doc_id, CAST(doc_id % 7 AS BIGINT) AS a FROM documents")
def fenced_json(spark, sf_dir):
    from cuelake.operators.models import unfence

    reply = F.concat(F.lit('```json\n{"a": '), (F.col("doc_id") % 7).cast("string"), F.lit("}\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", F.from_json(unfence(reply), "a long")["a"].alias("a"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang", "source").limit(1)


@query("SELECT CAST(doc_id AS VARCHAR) AS video_hash, strftime(make_timestamp(CAST(1704067200000000 + doc_id * 3600000000 AS BIGINT)), '%Y-%m-%d') AS date, CASE WHEN doc_id % 2 = 0 THEN doc_id * 1.5::DOUBLE END AS duration_seconds FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL FROM documents WHERE doc_id % 2 = 1")
def source_videos(spark, sf_dir):
    i = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(i.cast("string").alias("video_hash"))
    videos = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(i.cast("string").alias("video_hash"), F.lit("a.mp4").alias("name"), (i * 3600 + 1704067200).cast("double").alias("mtime"), (i * 1.5).cast("double").alias("duration_seconds"))
    return M.source_videos(files, videos).select("video_hash", "date", "duration_seconds")


@query("SELECT page_id, concat('https://***@h.org/a?token=***&n=', page_id) AS shown FROM pages")
def redacted_urls(spark, sf_dir):
    url = F.concat(F.lit("https://user:pw@h.org/a?token="), F.md5("url"), F.lit("&n="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", X.redact(url).alias("shown"))


@query("SELECT doc_id, CAST(5 AS INTEGER) AS top_k, CASE WHEN doc_id % 2 = 0 THEN 'hyde_alpha' END AS axis, CASE WHEN doc_id % 2 = 0 THEN lang END AS note FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def experiment_runs(spark, sf_dir):
    """Runs of two experiments with different columns, one top_k, one axis."""
    from cuelake.sources.readers import runs

    d = table(spark, sf_dir, "documents").withColumn("top_k", F.when(F.col("doc_id") % 3 == 0, 5).otherwise(10))
    a = d.where("doc_id % 2 = 0").select("doc_id", "top_k", F.lit("hyde_alpha").alias("axis"), F.col("lang").alias("note"))
    return runs(a, d.where("doc_id % 2 = 1").select("doc_id", "top_k"), top_k=5, axis="hyde_alpha")


@query("SELECT CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS BIGINT) AS failed FROM labels")
def split_failures(spark, sf_dir):
    from cuelake.sources.sinks import split_errors

    r = table(spark, sf_dir, "labels").select(F.struct(F.col("doc_id").alias("value"), F.when(F.coalesce(F.col("quality"), F.lit(0)) != 1, "bad").alias("error")).alias("result"))
    good, failed = split_errors(r)
    return good.agg(F.count("*").alias("good")).join(failed.agg(F.count("*").alias("failed")))
