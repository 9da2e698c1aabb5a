"""The context that a language model is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2000


def context(hits: DataFrame, keys: tuple[str, ...] = ("query_id",), with_date: bool = True, order: str = "rank") -> DataFrame:
    """One text per query: header, date, duration, timecodes and text of each document, in order. Lists are as long as top-k at most."""
    speechless = F.coalesce("is_speech_free", F.lit(False))
    chunk = F.when(F.coalesce("is_chunk", F.lit(False)), F.concat(F.lit(" [Chunk "), (F.coalesce("chunk_index", F.lit(0)) + 1).cast("string"), F.lit("/"), F.coalesce("total_chunks", F.lit(1)).cast("string"), F.lit("]")))
    header = F.concat(F.lit("[Document "), F.col(order).cast("string"), F.lit("]"), F.when(speechless, " [No transcript — description only]").otherwise(F.coalesce(chunk, F.lit(""))))
    seconds = F.col("duration_seconds").cast("long")
    duration = F.when(F.coalesce(seconds, F.lit(0)) > 0, F.format_string("Duration: %d:%02d", F.floor(seconds / 60).cast("long"), seconds % 60))
    codes = F.when(~speechless & (F.coalesce("start_time", F.lit("")) != "") & (F.coalesce("end_time", F.lit("")) != ""), F.concat(F.lit("Timecodes: "), "start_time", F.lit(" - "), "end_time"))
    text = F.when(F.length("text") > MAX_CHARS, F.concat(F.regexp_replace(F.substring("text", 1, MAX_CHARS), r"\s+$", ""), F.lit("..."))).otherwise(F.col("text"))
    body = F.concat(F.when(speechless, "Description: ").otherwise("Text: "), text)
    date = [F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit("Date: "), "date"))] if with_date else []
    block = F.concat(F.concat_ws("\n", header, *date, duration, codes, body), F.lit("\n"))
    rows = hits.select(*keys, F.struct(F.col(order).alias("o"), block.alias("b")).alias("s"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n").alias("context"))


def user_message(context_col, question, single_video: bool = False):
    head = "Transcript excerpts from the uploaded video:" if single_video else "Context from video transcripts:"
    return F.concat(F.lit(head + "\n"), context_col, F.lit("\n\nQuestion: "), question)
