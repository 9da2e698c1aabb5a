"""URLs, HTML fragments and article metadata."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.text import collapse, estimate_tokens

#: Host suffixes of known platforms.
SOURCE_HOSTS = [
    ("t.me", "telegram"), ("telegram.me", "telegram"), ("telegram.dog", "telegram"), ("youtube.com", "youtube"), ("youtu.be", "youtube"),
    ("x.com", "x"), ("twitter.com", "x"), ("vk.com", "vk"), ("vkvideo.ru", "vk"), ("ok.ru", "ok"), ("dzen.ru", "dzen"),
    ("rutube.ru", "rutube"), ("coub.com", "coub"), ("dailymotion.com", "dailymotion"), ("vimeo.com", "vimeo"),
]


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All of HTML's character references; neither engine has the table."""
    return text.map(html.unescape, na_action="ignore")


def basic_unescape(text: Column) -> Column:
    """The five references of XML and the no-break space, ampersand last."""
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def clean_html(text: Column, decode=unescape) -> Column:
    """References first, then tags to spaces."""
    return collapse(F.regexp_replace(decode(F.coalesce(text, F.lit(""))), "<[^>]+>", " "))


def strip_tags(text: Column, decode=unescape) -> Column:
    """Tags to nothing first, then references."""
    return collapse(decode(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def usage_source(url: Column) -> Column:
    """Platform label by host suffix; other, or invalid without a host."""
    h = host(url)
    out = F.lit("other")
    for suffix, label in reversed(SOURCE_HOSTS):
        out = F.when((h == suffix) | F.endswith(h, F.lit("." + suffix)), F.lit(label)).otherwise(out)
    return F.when(F.coalesce(h, F.lit("")) == "", F.lit("invalid")).otherwise(out)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, path without closing slashes, nothing after it."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)), path)


def urls_in(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(r"https?://[^\s,;]+"), F.lit(0))


def page_title(page: Column) -> Column:
    og = F.trim(F.regexp_extract(page, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1))
    return F.coalesce(F.nullif(og, F.lit("")), F.nullif(collapse(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))


def safe_link(url: Column) -> Column:
    """Only http and https, parentheses escaped."""
    return F.when(url.rlike("^(?i)https?:"), F.replace(F.replace(url, F.lit(")"), F.lit("\\)")), F.lit("("), F.lit("\\(")))


def sheet_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/spreadsheets/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def sheet_gid(url: Column) -> Column:
    """From the query, else the fragment, else 0."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"\?(?:[^#]*&)?gid=([^&#]+)", "#gid=(.*)$")]
    return F.coalesce(*found, F.lit("0"))


def telegram_ref(url: Column) -> Column:
    """Struct of kind (private, invite, public), channel and message; null for anything else. The last number is the message."""
    path = F.regexp_extract(F.trim(url), r"^(?i)https?://(?:www\.)?(?:t\.me|telegram\.me|telegram\.dog)(?-i)(/[^?#]*)", 1)
    private, invite, public = r"^/c/(\d+)(?:/(\d+))?(?:/(\d+))?/?$", r"^/(?:\+|joinchat/)([A-Za-z0-9_-]+)(?:/(\d+))?/?$", r"^/(?:s/)?([A-Za-z][A-Za-z0-9_]{3,31})(?:/(\d+))?(?:/(\d+))?/?$"
    last = lambda p: F.coalesce(F.nullif(F.regexp_extract(path, p, 3), F.lit("")), F.nullif(F.regexp_extract(path, p, 2), F.lit(""))).try_cast("long")
    made = lambda kind, p, message: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(path, p, 1).alias("channel"), message.alias("message"))
    invited = F.coalesce(F.nullif(F.regexp_extract(path, invite, 2), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    return (
        F.when(path.rlike(private), F.when(last(private).isNotNull(), made("private", private, last(private))))
        .when(path.rlike(invite), made("invite", invite, invited))
        .when(path.rlike(public), F.when(last(public).isNotNull(), made("public", public, last(public))))
    )


def clean_metadata(raw: DataFrame, decode=unescape) -> DataFrame:
    """Articles with a title or a description: web_title, web_date, web_date_ts, web_description, web_url."""
    title, url = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("name", "url"))
    parts = [F.nullif(clean_html(F.col(c), decode), F.lit("")) for c in ("preview_text", "detail_text")]
    moment = F.try_to_timestamp("date_active_start")
    out = raw.select("video_hash", title.alias("web_title"), F.date_format(moment, "yyyy-MM-dd").alias("web_date"), F.unix_micros(moment).cast("double").__truediv__(1e6).alias("web_date_ts"), F.nullif(F.concat_ws(" ", *parts), F.lit("")).alias("web_description"), url.alias("web_url"))
    return out.where("web_title is not null or web_description is not null")


def metadata_block(fields: tuple[str, ...] = ("title", "date", "description", "url"), label: str = "Video metadata:") -> Column:
    """Label and one line a field, in the wanted order; null without any value."""
    labels = {"title": "Title", "date": "Date", "description": "Description", "url": "URL"}
    known = [f for f in fields if f in labels]
    lines = [F.when(F.coalesce(F.col(f"web_{f}"), F.lit("")) != "", F.concat(F.lit(labels[f] + ": "), F.col(f"web_{f}"))) for f in known]
    joined = F.concat_ws("\n", *lines)
    return F.when(joined != "", F.concat_ws("\n", F.lit(label), joined))


def append_metadata(text: Column, block: Column, language: Column, most: int | None = None) -> Column:
    """Text, an empty line and the block, unless that would be too many tokens."""
    both = F.concat(text, F.lit("\n\n"), block)
    fits = F.lit(True) if most is None else estimate_tokens(both, language) <= most
    return F.when(block.isNotNull() & fits, both).otherwise(text)


def reserved_tokens(block: Column, language: Column, most: int) -> Column:
    """What a block leaves for the text, one at least."""
    return F.greatest(F.lit(1), F.lit(most) - F.coalesce(estimate_tokens(block, language), F.lit(0))).cast("int")
