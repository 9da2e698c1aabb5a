"""Queries on chunking, incremental updates, usage logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators import chunking as C
from cuelake.operators import incremental as I
from cuelake.operators import usage as U
from cuelake.plans.search_queries import KNN, near
from cuelake.registry import query, table
from cuelake.sources import vtt as V

LINES = "SELECT doc_id, lang, CAST(i AS INTEGER) AS rn, (i - 1) * 7.0::DOUBLE AS start_s, (i - 1) * 7.0::DOUBLE + 4 AS end_s, x AS text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def line_cues(spark, sf_dir):
    """Each line of a document as a cue, seven seconds apart."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    start = F.col("i") * 7.0
    return d.select("doc_id", "lang", (F.col("i") + 1).cast("int").alias("rn"), X.stamp_of(start).alias("start_time"), X.stamp_of(start + 4).alias("end_time"), start.alias("start_s"), (start + 4).alias("end_s"), "text")


def line_files(spark, sf_dir):
    return C.cues_of(line_cues(spark, sf_dir), "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query(
    f"""WITH RECURSIVE cues AS ({LINES}), win AS (SELECT doc_id, rn, start_s, CAST(CASE WHEN start_s >= 30 THEN 1 ELSE 0 END AS INTEGER) AS w FROM cues WHERE rn = 1 UNION ALL SELECT c.doc_id, c.rn, c.start_s, win.w + CASE WHEN c.start_s >= win.w * 20 + 30 THEN 1 ELSE 0 END FROM win JOIN cues c ON c.doc_id = win.doc_id AND c.rn = win.rn + 1),
placed AS (SELECT cues.*, w FROM cues JOIN win USING (doc_id, rn)), chunk AS (SELECT DISTINCT doc_id, w FROM placed), member AS (SELECT chunk.doc_id, chunk.w, p.rn, p.start_s, p.end_s, p.text FROM chunk JOIN placed p ON p.doc_id = chunk.doc_id AND (p.w = chunk.w OR (p.w < chunk.w AND p.start_s >= chunk.w * 20)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS INTEGER) AS chunk_index, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(text, ' ' ORDER BY rn) AS text, CAST(count(*) AS INTEGER) AS cue_count FROM member GROUP BY doc_id, w"""
)
def time_chunks(spark, sf_dir):
    f = line_files(spark, sf_dir)
    return C.exploded(f, C.by_time(F.col("cues"), 30, 10), "doc_id").drop("start_time", "end_time")


@query(
    f"""WITH RECURSIVE cues AS (SELECT *, CAST(floor(length(text) / CASE lang WHEN 'en' THEN 4.0::DOUBLE ELSE 3.5 END) AS INTEGER) AS t FROM ({LINES})),
p(doc_id, rn, g, held, alone) AS (SELECT doc_id, rn, 0, CASE WHEN t > 120 THEN 0 ELSE t + 1 END, t > 120 FROM cues WHERE rn = 1 UNION ALL
SELECT c.doc_id, c.rn, CASE WHEN c.t > 120 OR p.alone OR p.held + c.t + 1 > 120 THEN p.g + 1 ELSE p.g END, CASE WHEN c.t > 120 THEN 0 WHEN p.alone THEN c.t + 1 WHEN p.held + c.t + 1 > 120 THEN c.t ELSE p.held + c.t + 1 END, c.t > 120 FROM p JOIN cues c ON c.doc_id = p.doc_id AND c.rn = p.rn + 1)
SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, string_agg(text, ' ' ORDER BY rn) AS text, CAST(count(*) AS INTEGER) AS cue_count FROM p JOIN cues USING (doc_id, rn) GROUP BY doc_id, g"""
)
def token_chunks(spark, sf_dir):
    f = line_files(spark, sf_dir)
    return C.exploded(f, C._numbered(C.token_groups(F.col("cues"), 120, F.col("lang"))), "doc_id").select("doc_id", "chunk_index", "text", "cue_count")


@query()
def hybrid_chunks(spark, sf_dir):
    """Time, tokens and merging of small chunks together; tested against a plain Python version."""
    f = line_files(spark, sf_dir)
    return C.exploded(f, C.hybrid(F.col("cues"), F.col("lang"), 300, 30, 462, 50), "doc_id")


@query()
def chunk_documents(spark, sf_dir):
    """Index documents of all chunks, with ids, hashes and the point id."""
    f = line_files(spark, sf_dir).select(F.concat(F.lit("/archive/"), F.col("doc_id").cast("string"), F.lit(".en.vtt")).alias("path"), F.col("lang").alias("language"), F.expr("CASE WHEN doc_id % 11 = 0 THEN slice(cues, 1, 0) ELSE cues END").alias("cues"))
    return C.documents(f, C.hybrid(F.col("cues"), F.col("language"))).withColumn("point_id", X.point_id(F.col("id")))


def _files(spark, sf_dir):
    """A caption file per conversation, with ids, notes and markup."""
    c = table(spark, sf_dir, "conversations")
    said = F.regexp_replace("text", r"\s+", " ")
    stamp = lambda s: F.concat(X.stamp_of(s), F.lit(".500"))
    block = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.col("turn").cast("string"), F.lit("\n"))).otherwise("NOTE skip\n"), stamp(F.col("turn") * 7.0), F.lit(" --> "), stamp(F.col("turn") * 7.0 + 4), F.lit(" align:start\n<v "), "role", F.lit(">"), said, F.lit("\n<c.x>end</c>\n"))
    return c.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n")).alias("content"))


CLEAN = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]+>', '', 'g'))"


@query(f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rn, turn * 7.0::DOUBLE AS start_s, turn * 7.0::DOUBLE + 4 AS end_s, trim(regexp_replace(concat({CLEAN}, ' end'), '\\s+', ' ', 'g')) AS text FROM conversations")
def vtt_parse(spark, sf_dir):
    return V.parse(_files(spark, sf_dir), "conv_id").select("conv_id", "rn", "start_s", "end_s", "text")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rn, turn * 7.0::DOUBLE + 10.5 AS start_s, turn * 7.0::DOUBLE + 14.5 AS end_s, 'align:start' AS settings FROM conversations")
def vtt_parse_lenient(spark, sf_dir):
    return V.parse_blocks(_files(spark, sf_dir), "conv_id", offset=10.0).select("conv_id", "rn", "start_s", "end_s", "settings")


STAMP = "printf('%02d:%02d:%02d.%03d', CAST(floor({0} / 3600) AS BIGINT), CAST(floor({0} % 3600 / 60) AS BIGINT), CAST(floor({0} % 60) AS BIGINT), CAST(round({0} * 1000) AS BIGINT) % 1000)"


@query(f"SELECT conv_id, concat('WEBVTT', chr(10), chr(10), string_agg(concat({STAMP.format('s')}, ' --> ', {STAMP.format('e')}, chr(10), role), concat(chr(10), chr(10)) ORDER BY turn), chr(10)) AS content FROM (SELECT conv_id, turn, role, turn * 7.0::DOUBLE AS s, least(turn * 7.0::DOUBLE + 9, coalesce(lead(turn * 7.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn), 1e9)) AS e FROM conversations) GROUP BY conv_id")
def vtt_render(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 7.0).alias("start_s"), (F.col("turn") * 7.0 + 9).alias("end_s"), F.col("role").alias("text"))
    return V.render(c, "conv_id")


@query(
    """WITH RECURSIVE f AS (SELECT source, 900.0::DOUBLE + count(*) * 13 AS dur FROM documents GROUP BY source), sil AS (SELECT source, CAST(doc_id * 17 % 1500 AS DOUBLE) AS x FROM documents),
b(source, dur, cursor, n) AS (SELECT source, dur, 0.0::DOUBLE, 0 FROM f UNION ALL SELECT source, dur, cut, n + 1 FROM (SELECT b.source, b.dur, b.cursor, b.n, coalesce((SELECT arg_min(x, (abs(x - (b.cursor + 240)), x)) FROM sil WHERE sil.source = b.source AND x >= greatest(b.cursor + 60, b.cursor + 240 - 15) AND x <= least(b.dur - 60, b.cursor + 240 + 15)), b.cursor + 240) AS cut FROM b WHERE b.dur - b.cursor > 240) WHERE cut > cursor AND cut < dur)
SELECT source, CAST(n AS INTEGER) AS n, cursor AS cut FROM b WHERE n > 0"""
)
def audio_boundaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg((F.lit(900.0) + F.count("*") * 13).alias("dur"), F.array_sort(F.collect_list((F.col("doc_id") * 17 % 1500).cast("double"))).alias("sil"))
    cuts = d.select("source", F.posexplode(C.audio_boundaries(F.col("dur"), F.col("sil"), 240.0, 15.0)).alias("i", "cut"))
    return cuts.select("source", (F.col("i") + 1).cast("int").alias("n"), "cut")


@query("SELECT doc_id, CAST(unnest(generate_series(1, CAST(floor(n_chars * 40000.0::DOUBLE / 25165824) + 1 AS BIGINT))) AS BIGINT) AS part, CAST(floor(n_chars * 40000.0::DOUBLE / 25165824) + 1 AS BIGINT) AS parts FROM documents")
def size_safe_splits(spark, sf_dir):
    size = F.col("n_chars") * 40000.0
    d = table(spark, sf_dir, "documents").select("doc_id", C.size_safe_points(F.lit(0.0), F.lit(100.0), size, F.lit(100.0)).alias("points"))
    return d.select("doc_id", F.size("points").cast("long").alias("parts"), F.posexplode("points").alias("i", "x")).select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "parts")


# --- Incremental ------------------------------------------------------------------------------------------------------


def manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 1")
    return d.select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("file_hash"), F.array(F.col("doc_id").cast("string")).alias("doc_ids"))


def file_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    k = F.col("doc_id") % 7
    return d.select("doc_id", F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") + F.when(k.isin(1, 2), 5).otherwise(0)).cast("double").alias("mtime"), (F.col("n_chars") + F.when(k == 0, 1).otherwise(0)).alias("size"), F.sha2(F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("file_hash"))


STATES = "SELECT doc_id, concat('/a/', doc_id) AS path, CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 7 IN (0, 1) THEN 'modified' ELSE 'unchanged' END AS state FROM documents"


@query(f"SELECT path, state FROM ({STATES})")
def manifest_classify(spark, sf_dir):
    return I.classify_files(manifest(spark, sf_dir), file_state(spark, sf_dir))


@query(f"SELECT path, CASE WHEN state = 'unchanged' THEN CAST(doc_id AS VARCHAR) ELSE concat('n', doc_id) END AS doc_ids FROM ({STATES}) WHERE state = 'unchanged' OR (state IN ('new', 'modified') AND doc_id % 13 <> 0)")
def manifest_update(spark, sf_dir):
    """A file that yields no documents gets no entry."""
    files = file_state(spark, sf_dir)
    made = files.where("doc_id % 13 <> 0").select("path", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("doc_id"))
    old = manifest(spark, sf_dir)
    return I.updated_manifest(old, I.classify_files(old, files), files, made).select("path", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 10 = 1 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 10 <> 0")
def incremental_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    old, new = d.where("doc_id % 10 <> 1").withColumn("version", F.lit("old")), d.where("doc_id % 10 <> 0 and (doc_id % 7 = 0 or doc_id % 10 = 1)").withColumn("version", F.lit("new"))
    skip = d.where("doc_id % 10 = 0").union(d.where("doc_id % 7 = 0"))
    return I.updated_documents(old, skip, new)


def _points(spark, sf_dir, new: bool):
    d = table(spark, sf_dir, "documents").where(f"doc_id % 10 <> {0 if new else 1}")
    changed = F.when((F.col("doc_id") % 7 == 0) & F.lit(new), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select(X.point_id(F.col("doc_id").cast("string")).alias("point_id"), F.when(F.col("doc_id") % 11 != 0, F.sha2(changed, 256)).alias("content_hash"))


ACTIONS = "SELECT CASE WHEN doc_id % 10 = 0 THEN 'delete' WHEN doc_id % 10 <> 1 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN 'keep' ELSE 'upsert' END AS action FROM documents"


@query(f"SELECT action, CAST(count(*) AS BIGINT) AS n FROM ({ACTIONS}) GROUP BY action")
def index_diff(spark, sf_dir):
    return I.index_diff(_points(spark, sf_dir, False), _points(spark, sf_dir, True)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count(*) FILTER (WHERE action <> 'delete') AS BIGINT) AS total, CAST(count(*) FILTER (WHERE action = 'upsert') AS BIGINT) AS upserted, CAST(count(*) FILTER (WHERE action = 'delete') AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE action = 'keep') AS BIGINT) AS unchanged FROM ({ACTIONS})")
def index_diff_stats(spark, sf_dir):
    return I.diff_stats(I.index_diff(_points(spark, sf_dir, False), _points(spark, sf_dir, True)))


@query("WITH c AS (SELECT sha256(text) AS h, max(doc_id) AS row FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT d.doc_id, c.row AS vector_row, c.row IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.h = sha256(d.text)")
def embed_cache_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cache = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("row"), "text", F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("content_hash"), F.col("doc_id").alias("embedding"))
    hits, misses = I.cached_embeddings(d.select("doc_id", F.sha2("text", 256).alias("content_hash")), cache)
    return hits.select("doc_id", F.col("embedding").alias("vector_row"), F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(None).cast("long"), F.lit(False)))


@query("SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def latest_wins(spark, sf_dir):
    return I.latest(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT concat('/x/', source) AS path, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (WHERE doc_id % 2 = 0), '') AS doc_ids FROM documents GROUP BY source")
def manifest_rebuild(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("/x/"), "source").alias("path"), "doc_id")
    return I.rebuilt_manifest(d.select("path").distinct(), d.where("doc_id % 2 = 0").select("path", F.col("doc_id").cast("string")), 1).withColumn("doc_ids", F.array_join("doc_ids", ","))


# --- Usage ------------------------------------------------------------------------------------------------------------

USAGE = """SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_type = 'view' THEN 'other' ELSE 'video_import' END AS event, ['youtube', 'telegram', 'vk'][user_id % 3 + 1] AS source, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'http_403' ELSE 'ok' END AS outcome,
CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 THEN 'blocked' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS via, CAST(event_id * 10 AS BIGINT) AS bytes FROM events"""


def usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed, blocked = F.col("event_type") == "error", F.col("event_id") % 5 == 0
    line = U.line(F.when(F.col("event_type") == "view", "other").otherwise("video_import"), {
        "outcome": U.outcome(F.when(blocked & ~failed, 403), failed), "seconds": F.lit("1.5"), "source": F.element_at(F.array(*map(F.lit, ["youtube", "telegram", "vk"])), (F.col("user_id") % 3 + 1).cast("int")),
        "reason": F.when(failed, "failed").when(blocked, "blocked"), "via": F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"), "bytes": F.col("event_id") * 10, "empty": F.lit(""),
    })
    return U.parse(e.select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T10:00:00 host api: "), line).alias("value")))


@query(f"SELECT source, outcome, CAST(count(*) AS BIGINT) AS n, round(avg(1.5::DOUBLE), 3) AS seconds FROM ({USAGE}) WHERE event = 'video_import' GROUP BY source, outcome")
def usage_by_platform_outcome(spark, sf_dir):
    return usage(spark, sf_dir).where("event = 'video_import'").groupBy("source", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 3).alias("seconds"))


REPORT = " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (WHERE outcome = 'ok') AS BIGINT) AS succeeded, CAST(sum(bytes) AS BIGINT) AS bytes FROM u GROUP BY {v}" for k, v in (("source", "source"), ("date", "date"), ("via", "via"), ("reason", "coalesce(reason, '-')"))) + " UNION ALL SELECT 'all', '', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE outcome = 'ok') AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM u"


@query(f"WITH u AS (SELECT * FROM ({USAGE}) WHERE event = 'video_import') {REPORT}")
def usage_report(spark, sf_dir):
    return U.report(usage(spark, sf_dir))


@query(f"SELECT CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (WHERE outcome <> 'ok') AS BIGINT) AS failed, round(count(*) FILTER (WHERE outcome <> 'ok') / count(*), 6) AS share, count(*) >= 20 AND count(*) FILTER (WHERE outcome <> 'ok') / count(*) > 0.1 AS alarm FROM ({USAGE}) WHERE event = 'video_import'")
def failure_rate(spark, sf_dir):
    return U.failure_rate(usage(spark, sf_dir), 20, 0.1)


@query("WITH " + KNN + " SELECT query_id, CAST(label AS BIGINT) AS video_id, max(score) AS score, string_agg(doc_id, ',' ORDER BY kn.rank) AS docs, CAST(row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, min(doc_id)) AS INTEGER) AS place FROM kn JOIN embeddings ON vec_id = doc_id WHERE kn.rank <= 10 GROUP BY query_id, label")
def group_by_video(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("video_id"))
    g = U.by_video(near(spark, sf_dir, 10).join(v, "doc_id"))
    return g.select("query_id", "video_id", "score", F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("docs"), "place")


@query("SELECT strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 45 AS INTEGER) AS DATE) END AS d FROM documents)")
def archive_date_range(spark, sf_dir):
    text = F.when(F.col("doc_id") % 9 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 45).cast("int")), "yyyy-MM-dd")).otherwise("unknown")
    return table(spark, sf_dir, "documents").select(X.date_of(text).alias("d")).agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang, source QUALIFY row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) = 1")
def language_vote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("total"))
    return d.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("total"), "lang")).alias("lang"), F.max("total").alias("total"))


@query("SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY doc_id) AS INTEGER) AS n, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY doc_id) = 1 THEN name ELSE concat(name, '_', row_number() OVER (PARTITION BY name ORDER BY doc_id)) END AS unique_name FROM (SELECT doc_id, concat('recall_at_', doc_id % 5) AS name FROM documents)")
def metric_name_collisions(spark, sf_dir):
    from pyspark.sql.window import Window as W

    d = table(spark, sf_dir, "documents").select("doc_id", X.metric_name(F.concat(F.lit("recall@"), (F.col("doc_id") % 5).cast("string"))).alias("name"))
    n = F.row_number().over(W.partitionBy("name").orderBy("doc_id")).cast("int")
    d = d.withColumn("n", n)
    return d.select("name", "n", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string"))).alias("unique_name"))


def shown(df):
    """Window starts as text, which compares alike everywhere."""
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --- Streams ------------------------------------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    from cuelake.streaming import windows as S

    return shown(S.drained(S.tumbling(S.events(spark, sf_dir), "1 hour")))


@query("SELECT strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) t GROUP BY t.start")
def stream_sliding(spark, sf_dir):
    from cuelake.streaming import windows as S

    return shown(S.drained(S.sliding(S.events(spark, sf_dir), "1 hour", "30 minutes")))


@query("WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    from cuelake.streaming import windows as S

    return shown(S.drained(S.sessions(S.events(spark, sf_dir), "2 hours")))


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    from cuelake.streaming import windows as S

    once = S.deduplicated(S.events(spark, sf_dir), ["user_id", "event_type", "day"])
    return S.drained(once, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
