"""Queries on scalar functions, filters and simple sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions import web as H
from cuelake.registry import query, table

#: White space for DuckDB, whose \s is ASCII.
SP = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FOLDER = "CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'russian' ELSE 'mixed' END"
SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.ru' WHEN 1 THEN '.en' WHEN 2 THEN '' ELSE '_eng' END"
#: A caption file path for each document, in both engines.
PATHS = f"SELECT doc_id, lang, text, concat('/archive/', {FOLDER}, '/', md5(CAST(doc_id AS VARCHAR)), {SUFFIX}, '.vtt') AS path FROM documents"


def paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "russian").otherwise("mixed")
    k = F.col("doc_id") % 4
    suffix = F.when(k == 0, ".ru").when(k == 1, ".en").when(k == 2, "").otherwise("_eng")
    return d.select("doc_id", "lang", "text", F.concat(F.lit("/archive/"), folder, F.lit("/"), F.md5(F.col("doc_id").cast("string").cast("binary")), suffix, F.lit(".vtt")).alias("path"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '{SP}+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


BASIC = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({BASIC.format('html')}, '<[^>]+>', ' ', 'g'), '{SP}+', ' ', 'g')) AS clean FROM pages")
def html_clean_basic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.clean_html(F.col("html"), H.basic_unescape).alias("clean"))


STRIPPED = BASIC.format("regexp_replace(html, '<[^>]+>', '', 'g')")


@query(f"""SELECT page_id, trim(regexp_replace({STRIPPED}, '{SP}+', ' ', 'g')) AS stripped FROM pages""")
def html_strip_basic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.strip_tags(F.col("html"), H.basic_unescape).alias("stripped"))


@query()
def html_clean_full(spark, sf_dir):
    """With the whole table of references (an Arrow UDF; no SQL counterpart)."""
    return table(spark, sf_dir, "pages").select("page_id", H.clean_html(F.col("html")).alias("clean"), H.strip_tags(F.col("html")).alias("stripped"))


@query("SELECT doc_id, CAST(floor(length(text) / CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'ru' THEN 2.5 WHEN 'zh' THEN 1.5 WHEN 'ja' THEN 1.5 WHEN 'ar' THEN 3.0 ELSE 3.5 END) AS INTEGER) AS tokens FROM documents")
def token_estimate_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text"), F.col("lang")).alias("tokens"))


TOKENS = "SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{0}')) AS token FROM documents) GROUP BY token"


def _token_counts(spark, sf_dir, tokens):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(TOKENS.format(r"[\p{L}\p{N}_\-]+"))
def corpus_tokens(spark, sf_dir):
    return _token_counts(spark, sf_dir, X.corpus_tokens)


@query(TOKENS.format(r"[\p{L}\p{N}_]+"))
def query_tokens(spark, sf_dir):
    return _token_counts(spark, sf_dir, X.query_tokens)


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '{SP}', '', 'g'), '')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def cjk_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(X.cjk_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS content_hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


NS = X.NAMESPACE.replace("-", "")


@query(
    f"""WITH h AS (SELECT doc_id, sha1(from_hex('{NS}') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT doc_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id,
true AS valid FROM h"""
)
def uuid5_points(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.point_id(F.col("doc_id").cast("string")).alias("point_id"))
    return d.withColumn("valid", X.is_uuid(F.col("point_id")))


@query(
    f"""SELECT doc_id, substr(sha256(path), 1, 16) AS document_id, substr(sha256(concat(path, '_chunk_', CAST(doc_id % 7 AS VARCHAR))), 1, 16) AS chunk_id,
substr(sha256(concat('/archive/', split_part(path, '/', 3), '/', regexp_replace(regexp_replace(split_part(path, '/', 4), '\\.vtt$', ''), '\\.[^.]*$', ''))), 1, 16) AS video_id,
regexp_replace(regexp_replace(split_part(path, '/', 4), '\\.vtt$', ''), '\\.[^.]*$', '') AS video_hash FROM ({PATHS})"""
)
def chunk_ids(spark, sf_dir):
    p, d = F.col("path"), paths(spark, sf_dir)
    return d.select("doc_id", X.document_id(p).alias("document_id"), X.document_id(p, F.col("doc_id") % 7).alias("chunk_id"), X.video_id(p).alias("video_id"), X.video_hash(p).alias("video_hash"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ru' WHEN doc_id % 4 IN (1) THEN 'en' WHEN doc_id % 4 = 3 THEN 'en' WHEN lang = 'de' THEN 'ru' ELSE 'en' END AS language,
concat(split_part(path, '/', 3), '/', regexp_replace(regexp_replace(split_part(path, '/', 4), '\\.vtt$', ''), '\\.(en|ru)$', '')) AS group_id FROM ({PATHS})"""
)
def detect_language_tokens(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select("doc_id", X.detect_language(p).alias("language"), F.concat(X.parent_name(p), F.lit("/"), F.regexp_replace(X.stem(p), r"\.(en|ru)$", "")).alias("group_id"))


@query("SELECT doc_id, lower(sha1(CAST(doc_id AS VARCHAR))) AS safe, array_to_string(regexp_extract_all(sha1(CAST(doc_id AS VARCHAR)), '..'), '/') AS shard FROM documents")
def archive_shards(spark, sf_dir):
    h = F.upper(F.sha1(F.col("doc_id").cast("string").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_hash(h).alias("safe"), X.shard_path(F.lower(h)).alias("shard"))


STAMPS = "SELECT doc_id, doc_id * 37.125 AS s FROM documents"


@query(
    f"""SELECT doc_id, printf('%02d:%02d:%02d', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) % 3600 // 60, CAST(floor(s) AS BIGINT) % 60) AS stamp,
printf('%02d:%02d:%02d.%03d', CAST(s * 1000 AS BIGINT) // 3600000, CAST(s * 1000 AS BIGINT) % 3600000 // 60000, CAST(s * 1000 AS BIGINT) % 60000 // 1000, CAST(s * 1000 AS BIGINT) % 1000) AS stamp_ms,
s AS back, CAST(NULL AS DOUBLE) AS bad FROM (SELECT doc_id, CAST(s AS DOUBLE) AS s FROM ({STAMPS}))"""
)
def timestamps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * F.lit(37.125).cast("double")).alias("s"))
    d = d.select("doc_id", X.stamp_of(F.col("s")).alias("stamp"), X.stamp_ms_of(F.col("s")).alias("stamp_ms"))
    return d.select("doc_id", "stamp", "stamp_ms", X.seconds_of(F.regexp_replace("stamp_ms", r"\.", ",")).alias("back"), X.seconds_of(F.concat(F.lit("x"), "stamp")).alias("bad"))


@query(
    """SELECT item_id, CASE WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}_])(recent|recently|latest|last|new|current|today|yesterday|недавн|последн|новый|свежий|актуальн|сегодня|вчера)($|[^\\p{L}\\p{N}_])')
OR regexp_matches(q, 'this week|this month|this year|на этой неделе|в этом месяце|в этом году') THEN 'recent' WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}_])20[0-9]{2}($|[^\\p{L}\\p{N}_])') THEN 'specific' ELSE 'none' END AS sensitivity,
CASE WHEN item_id % 4 IN (0, 3) THEN '2024-01-02' END AS date_from, CASE WHEN item_id % 4 IN (0, 3) THEN '2024-02-01' END AS date_to
FROM (SELECT item_id, lower(concat(text, CASE item_id % 4 WHEN 0 THEN ' latest news' WHEN 1 THEN ' in May 2023.' WHEN 2 THEN ' renewed недавно' ELSE ' THIS month' END)) AS q FROM benchmark)"""
)
def temporal_sensitivity(spark, sf_dir):
    k = F.col("item_id") % 4
    tail = F.when(k == 0, " latest news").when(k == 1, " in May 2023.").when(k == 2, " renewed недавно").otherwise(" THIS month")
    q = table(spark, sf_dir, "benchmark").select("item_id", X.time_sensitivity(F.concat("text", tail)).alias("sensitivity"))
    a, b = X.recent_range(F.col("sensitivity"), F.lit("2024-02-01").cast("date"))
    return q.select("item_id", "sensitivity", F.date_format(a, "yyyy-MM-dd").alias("date_from"), F.date_format(b, "yyyy-MM-dd").alias("date_to"))


URLS = "SELECT page_id, html, url, concat(CASE page_id % 3 WHEN 0 THEN upper(split_part(url, '/', 1)) ELSE split_part(url, '/', 1) END, substr(url, length(split_part(url, '/', 1)) + 1)) AS raw FROM pages"
NORMAL = "concat(lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), regexp_replace(regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '/+$', ''))"


def _urls(spark, sf_dir):
    scheme = F.split_part("url", F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", "html", "url", F.concat(F.when(F.col("page_id") % 3 == 0, F.upper(scheme)).otherwise(scheme), F.substr("url", F.length(scheme) + 1)).alias("raw"))


@query(f"SELECT page_id, {NORMAL} AS normal, 1 AS n_urls FROM ({URLS})")
def url_normalize(spark, sf_dir):
    cell = F.concat(F.lit("see "), F.col("url"), F.lit(", then"))
    return _urls(spark, sf_dir).select("page_id", H.normalize_url(F.col("raw")).alias("normal"), F.size(H.urls_in(cell)).alias("n_urls"))


@query(f"SELECT normal, min(page_id) AS page_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, {NORMAL} AS normal FROM ({URLS})) WHERE normal <> '' GROUP BY normal")
def url_index_first_wins(spark, sf_dir):
    d = _urls(spark, sf_dir).select("page_id", H.normalize_url(F.col("raw")).alias("normal")).where("normal <> ''")
    return d.groupBy("normal").agg(F.min_by("page_id", "page_id").alias("page_id"), F.count("*").alias("n"))


@query(f"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{SP}+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


SITES = ["https://www.youtube.com/watch?v=", "http://t.me/c/12/", "https://m.vk.com/video", "https://user@dzen.ru:443/a/", "ftp:/bad/", "https://notyoutube.com/", "https://youtu.be/"]
SITE_LABELS = ["youtube", "telegram", "vk", "dzen", "invalid", "other", "youtube"]


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SITE_LABELS)) + " END AS source FROM pages) GROUP BY source")
def usage_source(spark, sf_dir):
    url = F.concat(F.element_at(F.array(*map(F.lit, SITES)), (F.col("page_id") % 7 + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(H.usage_source(url).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


TELEGRAM = ["https://t.me/c/{0}/5", "https://t.me/c/{0}/7/9", "http://t.me/+ab{0}", "https://telegram.me/joinchat/xyz/{0}", "https://t.me/s/channel/{0}", "https://t.me/channel/3/{0}/", "https://t.me/channel", "https://example.org/c/1/2"]


@query(
    """SELECT page_id, CASE WHEN k < 2 THEN 'private' WHEN k < 4 THEN 'invite' WHEN k < 6 THEN 'public' END AS kind,
CASE k WHEN 0 THEN i WHEN 1 THEN i WHEN 2 THEN concat('ab', i) WHEN 3 THEN 'xyz' WHEN 4 THEN 'channel' WHEN 5 THEN 'channel' END AS channel,
CASE k WHEN 0 THEN 5 WHEN 1 THEN 9 WHEN 2 THEN 0 WHEN 3 THEN page_id WHEN 4 THEN page_id WHEN 5 THEN page_id END AS message
FROM (SELECT page_id, page_id % 8 AS k, CAST(page_id AS VARCHAR) AS i FROM pages)"""
)
def telegram_links(spark, sf_dir):
    i = F.col("page_id").cast("string")
    url = F.replace(F.element_at(F.array(*map(F.lit, TELEGRAM)), (F.col("page_id") % 8 + 1).cast("int")), F.lit("{0}"), i)
    return table(spark, sf_dir, "pages").select("page_id", H.telegram_ref(url).alias("r")).select("page_id", "r.kind", "r.channel", "r.message")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'geo' WHEN 1 THEN 'blocked' WHEN 2 THEN 'geo' ELSE 'failed' END AS kind, event_id % 5 = 1 OR event_id % 7 = 0 AS transient FROM events"""
)
def failure_kinds(spark, sf_dir):
    said = ["The uploader has not made this video available from your location", "HTTP Error 429: Too Many Requests", "geo-restricted, http error 403", "Unsupported URL", "no media"]
    message = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(F.col("event_id") % 7 == 0, 503).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", X.failure_kind(message).alias("kind"), X.transient(status, message).alias("transient"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'pt-br' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'uk' END AS code,
CASE doc_id % 6 WHEN 0 THEN 'recall_at_5' WHEN 1 THEN 'a_b c' WHEN 2 THEN 'metric' ELSE 'x.y/z:1' END AS metric, CAST(CASE doc_id % 6 WHEN 0 THEN 12 WHEN 1 THEN 3 WHEN 2 THEN -1 ELSE 0 END AS INTEGER) AS number,
CASE doc_id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.9 WHEN 4 THEN NULL ELSE NULL END::DOUBLE AS share, CAST(CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 26 WHEN 3 THEN 27 ELSE 702 END AS INTEGER) AS col FROM documents"""
)
def small_parsers(spark, sf_dir):
    k = (F.col("doc_id") % 6 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k)
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.normalize_language(pick("English", " german ", "PT_br", "", "klingon!", "ukrainian")).alias("code"), X.metric_name(pick("recall@5", "a??b c ", " _ ", "x.y/z:1", "x.y/z:1", "x.y/z:1")).alias("metric"),
        X.safe_int(pick("12", "3.9", "-1", "none", "", "0")).alias("number"), X.share_of(pick("50", "50%", "0.5", "90", "x", "-3")).alias("share"), X.column_index(pick("A", "Z", "AA", "ab", "AAA", "AAA")).alias("col"),
    )


@query("SELECT event_id, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN printf('%.0f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.0f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS shown FROM (SELECT event_id, CAST(event_id AS DOUBLE) * event_id * 37 AS n FROM events)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.human_bytes(F.col("event_id").cast("double") * F.col("event_id") * 37).alias("shown"))


@query(
    """SELECT doc_id, CASE WHEN length(h) > 200 THEN concat(substr(h, 1, 200), '...') WHEN n > 3 THEN concat(h, '...') ELSE h END AS preview, length(h) > 200 OR n > 3 AS truncated, CAST(w AS INTEGER) AS words
FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS h, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents)"""
)
def text_previews(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("p"), X.word_count(F.col("text")).alias("words"))
    return d.select("doc_id", F.col("p.text").alias("preview"), "p.truncated", "words")


@query("SELECT doc_id, concat(65 + doc_id % 10, ',3661') AS seconds FROM documents")
def cited_timecodes(spark, sf_dir):
    answer = F.concat(F.lit("At 1:0"), (F.col("doc_id") % 10 + 5).cast("string"), F.lit(" and 01:01:01, again 1:01:01"))
    answer = F.when(F.col("doc_id") % 10 >= 5, F.concat(F.lit("At 1:"), (F.col("doc_id") % 10 + 5).cast("string"), F.lit(" and 01:01:01"))).otherwise(answer)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.timecodes(answer).cast("array<string>"), ",").alias("seconds"))


@query("SELECT page_id, 'abc-1_x' AS sheet, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN '77' ELSE '0' END AS gid, concat('https://e.org/a\\(', CAST(page_id AS VARCHAR), '\\)') AS link, concat('a_b ', CAST(page_id AS VARCHAR)) AS file FROM pages")
def sheet_links(spark, sf_dir):
    i = F.col("page_id").cast("string")
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("?x=1&gid="), i, F.lit("#gid=9"))).when(F.col("page_id") % 3 == 1, "#gid=77").otherwise("")
    url = F.concat(F.lit("https://docs.example.org/spreadsheets/d/abc-1_x/edit"), tail)
    return table(spark, sf_dir, "pages").select("page_id", H.sheet_id(url).alias("sheet"), H.sheet_gid(url).alias("gid"), H.safe_link(F.concat(F.lit("https://e.org/a("), i, F.lit(")"))).alias("link"), X.file_component(F.concat(F.lit(" a/:b  "), i, F.lit(" . "))).alias("file"))


META = f"""SELECT page_id, concat('h', CAST(page_id AS VARCHAR)) AS video_hash, nullif(trim(title), '') AS web_title, CASE WHEN page_id % 5 = 4 THEN NULL ELSE strftime(DATE '2024-01-01' + CAST(page_id % 45 AS INTEGER), '%Y-%m-%d') END AS web_date,
CASE WHEN page_id % 5 = 4 THEN NULL ELSE epoch(DATE '2024-01-01' + CAST(page_id % 45 AS INTEGER)) + 3600.0 END::DOUBLE AS web_date_ts, nullif(trim(concat_ws(' ', nullif(preview, ''), nullif(detail, ''))), '') AS web_description, nullif(trim(url), '') AS web_url
FROM (SELECT page_id, url, CASE WHEN page_id % 6 = 5 THEN '' ELSE substr(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), 1, 40) END AS title,
CASE WHEN page_id % 6 IN (4, 5) THEN '' ELSE concat('<b>Preview</b> ', CAST(page_id AS VARCHAR)) END AS p, CASE WHEN page_id % 6 = 5 THEN '' ELSE 'more &amp; more' END AS d, trim(regexp_replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS preview, replace(d, '&amp;', '&') AS detail FROM pages) WHERE title <> '' OR preview <> '' OR detail <> ''"""


def articles(spark, sf_dir):
    """A web article for each page."""
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 45).cast("int")), "yyyy-MM-dd")
    raw = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("h"), k.cast("string")).alias("video_hash"), "url", F.when(k % 6 == 5, "").otherwise(F.substring(F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1), 1, 40)).alias("name"),
        F.when(k % 5 == 4, "soon").otherwise(F.concat(day, F.lit("T01:00:00Z"))).alias("date_active_start"), F.when((k % 6).isin(4, 5), "").otherwise(F.concat(F.lit("<b>Preview</b> "), k.cast("string"))).alias("preview_text"), F.when(k % 6 == 5, "").otherwise("more &amp; more").alias("detail_text"),
    )
    return raw


@query(f"SELECT video_hash, web_title, web_date, web_date_ts, web_description, web_url FROM ({META})")
def web_metadata_clean(spark, sf_dir):
    return H.clean_metadata(articles(spark, sf_dir), H.basic_unescape)


BLOCK = "concat_ws(chr(10), 'Video metadata:', concat('Title: ', web_title), concat('Date: ', web_date), concat('Description: ', web_description), concat('URL: ', web_url))"


@query(f"SELECT video_hash, {BLOCK} AS block, CAST(greatest(1, 120 - floor(length({BLOCK}) / 4.0)) AS INTEGER) AS reserved, CASE WHEN floor(length(concat('some text', chr(10), chr(10), {BLOCK})) / 4.0) <= 40 THEN concat('some text', chr(10), chr(10), {BLOCK}) ELSE 'some text' END AS text FROM ({META.replace('concat(\'Title: \', web_title)', 'x')})".replace("concat('Title: ', web_title)", "CASE WHEN web_title IS NOT NULL THEN concat('Title: ', web_title) END").replace("concat('Date: ', web_date)", "CASE WHEN web_date IS NOT NULL THEN concat('Date: ', web_date) END").replace("concat('Description: ', web_description)", "CASE WHEN web_description IS NOT NULL THEN concat('Description: ', web_description) END"))
def metadata_block(spark, sf_dir):
    d = H.clean_metadata(articles(spark, sf_dir), H.basic_unescape).withColumn("block", H.metadata_block())
    en = F.lit("en")
    return d.select("video_hash", "block", H.reserved_tokens(F.col("block"), en, 120).alias("reserved"), H.append_metadata(F.lit("some text"), F.col("block"), en, 40).alias("text"))


@query(f"SELECT doc_id, coalesce(web_date, doc_date) AS date, web_date IS NOT NULL AS from_web FROM (SELECT doc_id, strftime(DATE '2023-01-01' + CAST(doc_id % 45 AS INTEGER), '%Y-%m-%d') AS doc_date, m.web_date FROM documents LEFT JOIN ({META}) m ON m.page_id = doc_id)")
def date_prefer(spark, sf_dir):
    m = H.clean_metadata(articles(spark, sf_dir), H.basic_unescape).select("video_hash", "web_date")
    own = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 45).cast("int")), "yyyy-MM-dd")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("video_hash"), own.alias("own")).join(m, "video_hash", "left")
    return d.select("doc_id", F.coalesce("web_date", "own").alias("date"), F.col("web_date").isNotNull().alias("from_web"))


@query(
    f"""SELECT page_id, name, CAST(row_number() OVER (ORDER BY CASE WHEN lower(name) = 'the' THEN 0 WHEN starts_with(lower(name), 'the') THEN 1 ELSE 2 END, day DESC, page_id) AS INTEGER) AS place
FROM (SELECT page_id, substr(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), 1, 40) AS name, CAST(page_id % 45 AS INTEGER) AS day FROM pages WHERE page_id % 6 <> 5) WHERE contains(lower(name), 'the') QUALIFY place <= 25"""
)
def title_search_ranked(spark, sf_dir):
    from cuelake.operators.metadata import search_titles

    return search_titles(articles(spark, sf_dir).withColumn("key", F.col("page_id")).withColumn("date_active_start", F.format_string("%03d", F.col("page_id") % 45)), "the", 25).select("page_id", "name", "place")


@query("SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 7)")
def exact_url_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.join(p.where("page_id = 7").select("url").distinct(), "url", "left_semi").select("page_id", "url")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents WHERE length(text) >= 50 AND lang IN ('en', 'de') AND doc_id % 11 <> 0 AND NOT starts_with(text, 'The')")
def chunk_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("is_speech_free", F.col("doc_id") % 11 == 0)
    return d.where(F.col("lang").isin("en", "de") & (F.length("text") >= 50) & ~F.col("is_speech_free") & ~F.startswith("text", F.lit("The"))).select("doc_id", F.length("text").alias("length"))


@query("SELECT CAST(count(*) FILTER (WHERE reviewed) AS BIGINT) AS reviewed, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS invalid, CAST(count(*) FILTER (WHERE valid IS NULL) AS BIGINT) AS undecided FROM (SELECT doc_id % 3 > 0 AS reviewed, CASE WHEN doc_id % 3 > 0 THEN quality = 1 END AS valid FROM labels)")
def review_counters(spark, sf_dir):
    reviewed = F.col("doc_id") % 3 > 0
    d = table(spark, sf_dir, "labels").select(reviewed.alias("reviewed"), F.when(reviewed, F.col("quality") == 1).alias("valid"))
    return d.agg(F.count_if("reviewed").alias("reviewed"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid").isNull()).alias("undecided"))


@query("SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS part, strftime(s, '%Y-%m-%d') AS first_day, strftime(least(CAST(s AS DATE) + 179, DATE '2024-12-31'), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(DATE '2022-03-01', DATE '2024-12-31', INTERVAL 180 DAY)) AS s)")
def export_ranges(spark, sf_dir):
    """Closed windows of 180 days between two dates."""
    a, b = F.lit("2022-03-01").cast("date"), F.lit("2024-12-31").cast("date")
    d = spark.range(1).select(F.posexplode(F.sequence(a, b, F.expr("INTERVAL 180 DAYS"))).alias("i", "first_day"))
    return d.select((F.col("i") + 1).cast("int").alias("part"), F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format(F.least(F.date_add("first_day", 179), b), "yyyy-MM-dd").alias("last_day"))


@query("SELECT page_id, sha1(CASE WHEN page_id % 3 <> 0 THEN concat(url, '|720p|', 1700000000 + page_id, '|', length(html)) ELSE concat(url, '|720p') END) AS key FROM pages")
def media_cache_keys(spark, sf_dir):
    known = F.col("page_id") % 3 != 0
    mtime, size = F.when(known, F.col("page_id") + 1700000000.25), F.when(known, F.length("html"))
    return table(spark, sf_dir, "pages").select("page_id", X.cache_key(F.col("url"), F.lit("720p"), mtime, size).alias("key"))


SECRET = "a shared secret"
#: The secret, padded to a block, under the two masks of a keyed hash.
INNER, OUTER = ("".join(f"\\x{b ^ mask:02X}" for b in SECRET.encode().ljust(64, b"\0")) for mask in (0x36, 0x5C))


@query(f"SELECT page_id, concat('v1.', m, '.', substr(sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode(m)))), 1, 32)) AS token, page_id % 2 = 1 AS good FROM (SELECT page_id, CAST(1700000000 + page_id % 2 AS VARCHAR) AS m FROM pages)")
def media_tokens(spark, sf_dir):
    """Tokens that end at two times, judged at the earlier; one in two is good no longer."""
    token = X.media_token(1700000000 + F.col("page_id") % 2, SECRET)
    return table(spark, sf_dir, "pages").select("page_id", token.alias("token")).select("page_id", "token", X.token_valid(F.col("token"), SECRET, F.lit(1700000000)).alias("good"))
