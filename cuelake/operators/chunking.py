"""Cues to chunks, as folds over a file's ordered cues; a file is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import content_hash, document_id, estimate_tokens, video_id

CUE = "array<struct<rn:int,start_time:string,end_time:string,start_s:double,end_s:double,text:string>>"
CHUNK = "struct<chunk_index:int,start_time:string,end_time:string,start_s:double,end_s:double,text:string,cue_count:int>"
#: A duration that no recording reaches: chunks by tokens only.
ENDLESS = 9_999_999


def cues_of(cues: DataFrame, key: str = "path") -> DataFrame:
    """One row per file: key, cues in order. A file's cues are bounded by the file size limit of the scan."""
    row = F.struct(F.col("rn").cast("int").alias("rn"), "start_time", "end_time", "start_s", "end_s", "text")
    return cues.groupBy(key).agg(F.array_sort(F.collect_list(row)).cast(CUE).alias("cues"))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _made(cues: Column, index: Column) -> Column:
    first, last = cues[0], F.element_at(cues, -1)
    return F.struct(
        index.cast("int").alias("chunk_index"), first["start_time"].alias("start_time"), last["end_time"].alias("end_time"), first["start_s"].alias("start_s"), last["end_s"].alias("end_s"),
        F.array_join(F.transform(cues, lambda c: c["text"]), " ").alias("text"), F.size(cues).alias("cue_count"),
    )


def _numbered(groups: Column) -> Column:
    return F.transform(groups, lambda g, i: _made(g, i))


def time_groups(cues: Column, duration: float = 300, overlap: float = 30) -> Column:
    """Cues by windows of a duration that overlap. The window moves once per cue beyond it, also across silence."""
    valid = F.filter(cues, lambda c: c["start_s"].isNotNull() & c["end_s"].isNotNull())
    start = F.struct(F.lit(0.0).alias("begin"), _empty(CUE).alias("held"), _empty(f"array<{CUE}>").alias("done"))

    def step(s, c):
        over = c["start_s"] >= s["begin"] + float(duration)
        begin = F.when(over, s["begin"] + float(duration - overlap)).otherwise(s["begin"])
        held = F.when(over, F.filter(s["held"], lambda h: h["start_s"] >= s["begin"] + float(duration - overlap))).otherwise(s["held"])
        done = F.when(over & (F.size(s["held"]) > 0), F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"])
        return F.struct(begin.alias("begin"), F.concat(held, F.array(c)).alias("held"), done.alias("done"))

    return F.aggregate(valid, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]))


def token_groups(cues: Column, most: int, language: Column) -> Column:
    """Greedy packing. A cue over the limit stands alone; each cue costs one more token once anything is held."""
    start = F.struct(F.lit(0).alias("tokens"), _empty(CUE).alias("held"), _empty(f"array<{CUE}>").alias("done"))

    def step(s, c):
        t, some = estimate_tokens(c["text"], language), F.size(s["held"]) > 0
        flushed = F.when(some, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"])
        alone = F.struct(F.lit(0).alias("tokens"), _empty(CUE).alias("held"), F.concat(flushed, F.array(F.array(c))).alias("done"))
        fresh = F.struct(t.alias("tokens"), F.array(c).alias("held"), flushed.alias("done"))
        more = F.struct((s["tokens"] + t + 1).cast("int").alias("tokens"), F.concat(s["held"], F.array(c)).alias("held"), s["done"].alias("done"))
        return F.when(t > most, alone).when(some & (s["tokens"] + t + 1 > most), fresh).otherwise(more)

    return F.aggregate(cues, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]))


def _joined(a: Column, b: Column) -> Column:
    return F.struct(
        a["chunk_index"].alias("chunk_index"), a["start_time"].alias("start_time"), b["end_time"].alias("end_time"), a["start_s"].alias("start_s"), b["end_s"].alias("end_s"),
        F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), (a["cue_count"] + b["cue_count"]).cast("int").alias("cue_count"),
    )


def merge_small(chunks: Column, least: int, most: int, language: Column) -> Column:
    """Chunks under `least` tokens join the one before, else the one after, if the two fit; else they stay. The left index stays."""
    start = F.struct(F.lit(False).alias("skip"), _empty(f"array<{CHUNK}>").alias("done"))

    def step(s, x):
        c, nxt, done = x["c"], x["n"], s["done"]
        last = F.try_element_at(done, F.lit(-1))
        fits = lambda a, b: F.coalesce(estimate_tokens(F.concat(a["text"], F.lit(" "), b["text"]), language) <= most, F.lit(False))
        keep = F.struct(F.lit(False).alias("skip"), F.concat(done, F.array(c)).alias("done"))
        back = F.struct(F.lit(False).alias("skip"), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_joined(last, c))).alias("done"))
        ahead = F.struct(F.lit(True).alias("skip"), F.concat(done, F.array(_joined(c, nxt))).alias("done"))
        idle = F.struct(F.lit(False).alias("skip"), done.alias("done"))
        return F.when(s["skip"], idle).when(estimate_tokens(c["text"], language) >= least, keep).when(fits(last, c), back).when(fits(c, nxt), ahead).otherwise(keep)

    pairs = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), F.try_element_at(chunks, i + 2).alias("n")))
    return F.aggregate(pairs, start, step, lambda s: s["done"])


def hybrid(cues: Column, language: Column, duration: float = 300, overlap: float = 30, most: int = 462, least: int = 50) -> Column:
    """Windows of time; those over the token limit repacked from the cues that start within them; small ones merged."""
    windows = _numbered(time_groups(cues, duration, overlap))
    within = lambda w: F.filter(cues, lambda c: c["start_s"].isNotNull() & c["end_s"].isNotNull() & (c["start_s"] >= w["start_s"]) & (c["start_s"] < w["end_s"]))
    parts = F.flatten(F.transform(windows, lambda w: F.when(estimate_tokens(w["text"], language) <= most, F.array(w)).otherwise(_numbered(token_groups(within(w), most, language)))))
    renumbered = F.transform(parts, lambda c, i: c.withField("chunk_index", i.cast("int")))
    return merge_small(renumbered, least, most, language)


def by_time(cues: Column, duration: float = 300, overlap: float = 30) -> Column:
    return _numbered(time_groups(cues, duration, overlap))


def by_tokens(cues: Column, language: Column, most: int = 462, least: int = 50) -> Column:
    return hybrid(cues, language, ENDLESS, 0, most, least)


def exploded(files: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    return files.select(*keep, F.explode(chunks).alias("c")).select(*keep, "c.*")


def documents(files: DataFrame, chunks: Column) -> DataFrame:
    """files: path, language, cues. Index documents of their chunks; a file without cues yields one speech-free document without a hash."""
    path = F.col("path")
    whole = files.withColumn("chunks", chunks).withColumn("total", F.size("chunks"))
    rows = whole.select("path", "language", "total", F.explode_outer("chunks").alias("c"))
    n, speechless = F.col("c.chunk_index"), F.col("c").isNull()
    text = F.coalesce("c.text", F.lit(""))
    return rows.select(
        F.when(speechless, document_id(path)).otherwise(document_id(path, n)).alias("id"), "path", "language", text.alias("text"), F.length(text).alias("length"), F.col("c.start_time"), F.col("c.end_time"), video_id(path).alias("video_id"),
        (~speechless).alias("is_chunk"), n.alias("chunk_index"), F.when(~speechless, F.col("total")).alias("total_chunks"), F.col("c.start_s").alias("start_time_seconds"), F.col("c.end_s").alias("end_time_seconds"),
        F.when(~speechless, content_hash(text)).alias("content_hash"), speechless.alias("is_speech_free"),
    )


def audio_boundaries(duration: Column, silences: Column, every: float, window: float) -> Column:
    """Cut points about `every` seconds, at the silence nearest to the target within the window, never near an end."""
    smallest = min(60.0, every / 4)
    start = F.struct(F.lit(0.0).alias("cursor"), F.lit(False).alias("done"), _empty("array<double>").alias("cuts"))

    def step(s, _):
        target = s["cursor"] + every
        low, high = F.greatest(s["cursor"] + smallest, target - window), F.least(duration - smallest, target + window)
        best = F.array_min(F.transform(F.filter(silences, lambda x: (x >= low) & (x <= high)), lambda x, i: F.struct(F.abs(x - target).alias("far"), i.alias("i"), x.alias("x"))))["x"]
        cut = F.coalesce(best, target)
        stop = s["done"] | (duration - s["cursor"] <= every) | (cut <= s["cursor"]) | (cut >= duration)
        return F.when(stop, F.struct(s["cursor"].alias("cursor"), F.lit(True).alias("done"), s["cuts"].alias("cuts"))).otherwise(F.struct(cut.alias("cursor"), F.lit(False).alias("done"), F.concat(s["cuts"], F.array(cut)).alias("cuts")))

    # A cut is at least `smallest` after the one before.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(duration / smallest).cast("int")))
    return F.aggregate(steps, start, step)["cuts"]


def size_safe_points(start: Column, end: Column, size: Column, total: Column, limit: int = 24 * 1024 * 1024) -> Column:
    """Ends of the parts of a stretch whose share of the file stays under the upload limit."""
    parts = (F.floor(size * (end - start) / total / limit) + 1).cast("int")
    return F.transform(F.sequence(F.lit(1), parts), lambda p: start + (end - start) * p / parts)
