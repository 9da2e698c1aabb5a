"""Explicit schemas of the persisted tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(text)


DOCUMENT = (
    "id STRING, path STRING, language STRING, text STRING, length INT, date STRING, date_ts DOUBLE, duration_seconds DOUBLE, start_time STRING, end_time STRING, "
    "video_id STRING, is_chunk BOOLEAN, chunk_index INT, total_chunks INT, start_time_seconds DOUBLE, end_time_seconds DOUBLE, web_title STRING, web_date STRING, "
    "web_date_ts DOUBLE, web_description STRING, web_url STRING, content_hash STRING, is_speech_free BOOLEAN"
)
CUE = "rn INT, start_time STRING, end_time STRING, start_s DOUBLE, end_s DOUBLE, text STRING"
CHUNK = "chunk_index INT, start_time STRING, end_time STRING, start_s DOUBLE, end_s DOUBLE, text STRING, cue_count INT"
MANIFEST = "path STRING, mtime DOUBLE, size LONG, file_hash STRING, doc_ids ARRAY<STRING>"
WEB_METADATA = "video_hash STRING, name STRING, date_active_start STRING, url STRING, preview_text STRING, detail_text STRING, teleshow STRUCT<name: STRING>"
EVAL_RECORD = (
    "query_id STRING, query STRING, language STRING, relevant_doc_ids ARRAY<STRING>, reference_answer STRING, category STRING, temporal BOOLEAN, "
    "source_doc_id STRING, source_path STRING, source_date STRING, reviewed BOOLEAN, valid BOOLEAN"
)
#: Fields that an index keeps of a document: all of them, so that same-video filters and chunk headers work.
PAYLOAD = [f.split(" ")[0] for f in DOCUMENT.split(", ")]
