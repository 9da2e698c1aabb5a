"""The training-corpus pipeline: five stages from documents to token ids, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common, decontaminate, near_copies, pii, quality
from cuelake.llm.queries import WORD_MODEL, vocabulary
from cuelake.llm.sentencepiece_ops import encode_documents
from cuelake.llm.suffix_dedup import row_keys

#: SQL can express none of the stages; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the classifier's threshold. Learns from the labelled rows of its own input.

    Null and empty texts score the share of good labels; without any label everything scores 0.5 and stays.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    aside = common.free_name(docs.columns, "__score")  # the operator's column is called score
    given = "score" in docs.columns
    scored = quality.score(docs.withColumnRenamed("score", aside) if given else docs, quality.fit(docs, labels))
    kept = scored.where(F.col("score") >= quality.THRESHOLD).drop("score")
    return (kept.withColumnRenamed(aside, "score") if given else kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by near copies (five-word shingles, similarity of 0.8): the one with the smallest doc_id.

    Every row is a document of its own: different texts that share a doc_id, or have none, all stay. Of copies under one
    doc_id one row stays, and a row with a doc_id goes before one without. Texts without words, null ones too, are copies
    of each other.
    """
    rid = common.free_name(docs.columns, "__row")
    rows = row_keys(docs, rid)
    found = near_copies.near_copies(rows.select(F.col(rid).alias("doc_id"), "text"))
    ids = rows.select(F.col(rid).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = found.withColumnRenamed("doc_id", "row").join(ids, "row").groupBy("component_id").agg(F.min_by("row", order).alias(rid)).select(rid)
    return rows.join(first, rid, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item. Null and empty texts hold none and stay, as do all without any item."""
    found = common.free_name(docs.columns, "matches")
    flagged = decontaminate.flag(docs, common.table(spark, sf_dir, "benchmark"), into=found)
    return flagged.where(F.size(found) == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span in the texts; n_chars follows. Null texts stay null, with a null n_chars."""
    masked = pii.mask(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids: piece_ids (little-endian unsigned 32-bit integers) and their number, n_ids.

    Null and empty texts have no ids. If the documents have columns of these names already, they stay as they are and
    the new ones are called piece_ids_1 and n_ids_1, or the next free number.
    """
    given = {c: common.free_name([*docs.columns, "piece_ids", "n_ids"], f"__{c}") for c in docs.columns if c.lower() in ("piece_ids", "n_ids")}
    ids, number = (common.free_name(docs.columns, c) for c in ("piece_ids", "n_ids"))
    out = encode_documents(docs.withColumnsRenamed(given), vocabulary(WORD_MODEL))
    out = out.withColumn("n_ids", (F.length("piece_ids") / 4).cast("long")).withColumnsRenamed({"piece_ids": ids, "n_ids": number})
    return out.withColumnsRenamed({v: k for k, v in given.items()}).select(*docs.columns, ids, number)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables go once its result is written, and that once the next stage's is."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, others = common.scratch(spark, f"pipeline-{name}"), common.left()
        docs = common.write(stage(spark, docs, sf_dir), path, codec="snappy")
        common.drop_since(others)
        if before:
            common.remove(spark, before)
        before = path
    return docs
