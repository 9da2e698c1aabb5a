"""Scalar functions on text, paths, times and ids, as column expressions."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that every engine agrees.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]"

# --- Fixed values -------------------------------------------------------------------------------------------------
#: Characters per token by language; others 3.5.
TOKEN_RATIOS = {"en": 4.0, "ru": 2.5, "zh": 1.5, "ja": 1.5, "ar": 3.0}
RUSSIAN_MARKS, ENGLISH_MARKS = ["ru", "rus", "russian"], ["en", "eng", "english"]
#: Name space of the point ids.
NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
LANGUAGE_CODES = {
    "english": "en", "russian": "ru", "ukrainian": "uk", "french": "fr", "german": "de", "spanish": "es",
    "italian": "it", "portuguese": "pt", "polish": "pl", "belarusian": "be", "georgian": "ka",
}
#: Most tokens that an embedding model reads.
MODEL_LIMITS = {
    "intfloat/multilingual-e5-large": 512, "intfloat/multilingual-e5-base": 512, "intfloat/multilingual-e5-small": 512,
    "sentence-transformers/all-MiniLM-L6-v2": 256, "sentence-transformers/all-mpnet-base-v2": 384,
    "text-embedding-3-large": 8191, "text-embedding-3-small": 8191, "text-embedding-ada-002": 8191,
    "embed-english-v3.0": 512, "embed-multilingual-v3.0": 512, "embed-english-light-v3.0": 512, "embed-multilingual-light-v3.0": 512,
    "mistral-embed": 512, "models/text-embedding-004": 3072, "models/embedding-001": 2048,
}


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(text: Column) -> Column:
    """Markup out, white space collapsed, trimmed."""
    return collapse(F.regexp_replace(text, "<[^>]+>", ""))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def video_hash(path: Column) -> Column:
    """Stem without a language suffix."""
    return F.regexp_replace(stem(path), r"\.[^.]*$", "")


def detect_language(path: Column) -> Column:
    """By the file name's tokens, then by the folder's; Russian marks before English ones; else English."""
    out = F.lit("en")
    for part in (parent_name(path), F.regexp_extract(path, r"([^/]*)$", 1)):
        tokens = F.split(F.lower(part), "[^a-z0-9]+")
        marked = lambda marks: F.arrays_overlap(tokens, F.array(*map(F.lit, marks)))  # noqa: B023, E731
        out = F.when(marked(RUSSIAN_MARKS), "ru").when(marked(ENGLISH_MARKS), "en").otherwise(out)
    return out


def seconds_of(stamp: Column) -> Column:
    """Seconds of H:M:S(.f) or M:S(.f), with a comma or a point; null if it is neither."""
    parts = F.split(F.regexp_replace(F.trim(stamp), ",", "."), ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(parts) == 2, part(1) * 60 + part(2))


def stamp_of(seconds: Column) -> Column:
    """HH:MM:SS, rounded down."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def stamp_ms_of(seconds: Column) -> Column:
    """HH:MM:SS.mmm, rounded to the millisecond; negative counts as zero."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms % 3600000 / 60000).cast("long"), F.floor(ms % 60000 / 1000).cast("long"), ms % 1000)


def ratio_of(language: Column) -> Column:
    out = F.lit(3.5).cast("double")
    for code, ratio in TOKEN_RATIOS.items():
        out = F.when(language == code, F.lit(ratio).cast("double")).otherwise(out)
    return out


def estimate_tokens(text: Column, language: Column) -> Column:
    return F.floor(F.length(text) / ratio_of(language)).cast("int")


def max_chunk_tokens(model: str, buffer: int = 50, explicit: int | None = None, default: int = 512) -> int:
    return explicit if explicit is not None else max(1, MODEL_LIMITS.get(model, default) - buffer)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def document_id(path: Column, chunk: Column | None = None) -> Column:
    return short_hash(path if chunk is None else F.concat(path, F.lit("_chunk_"), chunk.cast("string")))


def video_id(path: Column) -> Column:
    """Shared by all languages of a video."""
    return short_hash(F.concat(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("/"), video_hash(path)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_id(doc_id: Column) -> Column:
    """UUID of version 5 in the fixed name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(doc_id, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?i)(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"), F.lit(False))


def safe_hash(text: Column) -> Column:
    """Forty hex digits in lower case, else null."""
    return F.when(text.rlike("^[a-fA-F0-9]{40}$"), F.lower(text))


def shard_path(digits: Column) -> Column:
    """Two characters a folder; null unless an even number of hex digits."""
    return F.when(digits.rlike("^([0-9a-fA-F]{2})+$"), F.regexp_replace(digits, "(..)(?=.)", "$1/"))


def corpus_tokens(text: Column) -> Column:
    """Words of documents: hyphens belong to them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Words of queries: hyphens do not belong to them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def cjk_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, SPACE, ""), ""), lambda c: c != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))


def prefixed(title: Column, text: Column, prefix: str | None = None, model: str = "") -> Column:
    """Title and text as a passage; models of the e5 family want a prefix."""
    return F.concat(F.lit(prefix if prefix is not None else "passage: " if "e5" in model.lower() else ""), F.trim(F.concat_ws(" ", title, text)))


def date_of(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def normalize_language(name: Column) -> Column:
    value = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "_", "-")
    out = F.when(value.rlike("^[a-z]{2,3}(-[a-z0-9]+)?$"), value)
    for word, code in LANGUAGE_CODES.items():
        out = F.when(value == word, F.lit(code)).otherwise(out)
    return out


def metric_name(name: Column) -> Column:
    mapped = F.regexp_replace(F.trim(name), "@", "_at_")
    safe = F.regexp_replace(F.regexp_replace(mapped, r"[^A-Za-z0-9_\-. /:]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^[ _]+|[ _]+$", ""), F.lit("")), F.lit("metric"))


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(default))


def file_component(name: Column) -> Column:
    out = F.regexp_replace(collapse(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|\r\n\t]+', "_")
    return F.regexp_replace(out, "^[ .]+|[ .]+$", "")


def column_index(letters: Column) -> Column:
    """Zero-based index of spreadsheet column letters."""
    codes = F.transform(F.split(F.upper(F.trim(letters)), ""), lambda c: F.ascii(c) - 64)
    return (F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0), lambda a, x: a * 26 + x) - 1).cast("int")


def preview(text: Column, lines: int = 3, chars: int = 200) -> Column:
    """Struct of the first lines, cut to so many characters, and whether anything is missing."""
    parts = F.split(text, "\n")
    head = F.concat_ws("\n", F.slice(parts, 1, lines))
    long, more = F.length(head) > chars, F.size(parts) > lines
    return F.struct(F.when(long, F.concat(F.substring(head, 1, chars), F.lit("..."))).when(more, F.concat(head, F.lit("..."))).otherwise(head).alias("text"), (long | more).alias("truncated"))


def timecodes(text: Column, limit: int = 12) -> Column:
    """Distinct seconds of the first cited timecodes."""
    found = F.regexp_extract_all(text, F.lit(r"\b(?:\d{1,2}:)?[0-5]?\d:[0-5]\d\b"), F.lit(0))
    seconds = F.transform(found, lambda x: F.aggregate(F.transform(F.split(x, ":"), lambda p: p.cast("int")), F.lit(0), lambda a, p: a * 60 + p))
    return F.slice(F.array_distinct(seconds), 1, limit)


def redact(text: Column) -> Column:
    """Credentials in URLs and key=value pairs masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(token|key|password|secret|signature)=[^&\s]+", "$1=***"), r"://[^/@\s]+@", "://***@")


def share_of(text: Column) -> Column:
    """A threshold as a fraction: a percent sign or a number over one means percent; null if out of range or no number."""
    trimmed = F.trim(text)
    explicit = F.endswith(trimmed, F.lit("%"))
    value = F.trim(F.regexp_replace(trimmed, "%$", "")).try_cast("double")
    out = F.when(explicit | (value > 1), value / 100).otherwise(value)
    return F.when((out >= 0) & (out <= 1), out)


def _fixed(x: Column, places: int) -> Column:
    """The number with so many decimal places, half to even by its exact value (format_string rounds its shortest digits half up); all digits up to 2^106."""
    high = F.floor(x / 2.0**53)
    whole = high.cast("decimal(17,0)") * F.lit(Decimal(2**53)) + (x - high * F.lit(2.0**53)).cast("long")
    point = "." + "0" * places if places else ""
    return F.when((x >= 2.0**53) & (x < 2.0**106), F.concat(whole.cast("string"), F.lit(point))).otherwise(F.call_function("format_number", x, F.lit("0" + point)))


def human_bytes(n: Column) -> Column:
    """A size with its unit; null for null."""
    n = n.cast("double")
    shown = F.when(n < 1024, F.concat(_fixed(n, 0), F.lit(" B"))).when(n < 1024**2, F.concat(_fixed(n / 1024, 0), F.lit(" KB")))
    return shown.when(n < 1024**3, F.concat(_fixed(n / 1024**2, 0), F.lit(" MB"))).otherwise(F.concat(_fixed(n / 1024**3, 1), F.lit(" GB")))


# What makes a provider's failure worth a retry.
TRANSIENT_STATUS = (429, 500, 502, 503, 504)
TRANSIENT_MARKS = "rate limit|rate_limit|too many requests|service unavailable|temporary failure|connection error|network error|timeout|internal server error"


def transient(status: Column, message: Column) -> Column:
    """Whether a failure is worth a retry."""
    return F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False)) | F.coalesce(F.lower(message).rlike(TRANSIENT_MARKS), F.lit(False))


def cache_key(path: Column, quality: Column, mtime: Column, size: Column) -> Column:
    """Key of a video's generated streams: of its path, quality, modification (whole seconds) and size, without the last two if either is null."""
    stamp = F.concat_ws("|", path, quality, F.floor(mtime).cast("string"), size.cast("string"))
    return F.sha1(F.when(mtime.isNotNull() & size.isNotNull(), stamp).otherwise(F.concat_ws("|", path, quality)).cast("binary"))


def hmac_sha256(message: Column, secret: str) -> Column:
    """Keyed hash of a text, as lowercase hex digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def media_token(expires: Column, secret: str) -> Column:
    """A token that is good until `expires` (whole seconds since 1970); empty without a secret."""
    if not secret:
        return F.lit("")
    payload = expires.cast("long").cast("string")
    return F.concat(F.lit("v1."), payload, F.lit("."), F.substring(hmac_sha256(payload, secret), 1, 32))


def token_valid(token: Column, secret: str, now: Column) -> Column:
    """Is a media token well formed, rightly signed and not expired? A null one is not."""
    parts = F.split(token, r"\.")
    payload, signature = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    signed = (F.size(parts) == 3) & (parts[0] == "v1") & (signature == F.substring(hmac_sha256(payload, secret), 1, 32))
    return F.coalesce(signed & (now < payload.try_cast("long")), F.lit(False))


def failure_kind(message: Column) -> Column:
    """geo before blocked before failed."""
    # Fixed values.
    geo = "available from your location|blocked it in your country|not available in your country|geo restricted|geo-restricted"
    blocked = "http error 403|sign in to confirm|not a bot|http error 429|too many requests|rate limit"
    text = F.lower(message)
    return F.when(text.rlike(geo), "geo").when(text.rlike(blocked), "blocked").otherwise("failed")


def time_sensitivity(text: Column) -> Column:
    """recent, specific or none. Russian stems count only as whole words."""
    # Fixed values.
    words = "recent|recently|latest|last|new|current|today|yesterday|недавн|последн|новый|свежий|актуальн|сегодня|вчера"
    phrases = "this week|this month|this year|на этой неделе|в этом месяце|в этом году"
    lower = F.lower(text)
    edge = r"(^|[^\p{L}\p{N}_])"
    recent = lower.rlike(edge + "(" + words + r")($|[^\p{L}\p{N}_])") | lower.rlike(phrases)
    return F.when(recent, "recent").when(lower.rlike(edge + r"20[0-9]{2}($|[^\p{L}\p{N}_])"), "specific").otherwise("none")


def recent_range(sensitivity: Column, as_of: Column, days: int = 30) -> tuple[Column, Column]:
    """The dates that a recent query covers; nulls for others."""
    return F.when(sensitivity == "recent", F.date_sub(as_of, days)), F.when(sensitivity == "recent", as_of)
