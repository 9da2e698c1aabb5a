"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.llm import common

WORD_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; read by the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip: is the decoded text the text (nulls as empty)."""
    from cuelake.llm.sentencepiece_ops import encode_documents

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, vocabulary(WORD_MODEL), decode=True)
    return out.select("doc_id", (F.length("piece_ids") / 4).cast("long").alias("n_ids"), F.crc32("piece_ids").alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op2_hilbert_neighbours(spark, sf_dir):
    from cuelake.llm.hilbert import search

    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 20 == 0)


def op3_simhash(spark, sf_dir):
    from cuelake.llm.simhash import near_duplicates

    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark, sf_dir):
    """Also n_passages and passage_words: passages of over 50 words that start anywhere else too, which may be shorter than 400 bytes."""
    from cuelake.llm.suffix_dedup import deduplicate

    out = deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words")


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_pii(spark, sf_dir):
    from cuelake.llm import pii

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k))
    counts = [number(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def op6_quality(spark, sf_dir):
    from cuelake.llm import quality

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(common.bucket("doc_id", 5) != 0)
    out = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", (common.bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_decontaminate(spark, sf_dir):
    from cuelake.llm.decontaminate import pairs

    return pairs(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


def op8_html_text(spark, sf_dir):
    from cuelake.llm.html_text import extract

    out = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_token_files(spark, sf_dir):
    from cuelake.llm.token_files import token_files

    return token_files(common.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(BYTE_MODEL))


def op10_language(spark, sf_dir):
    from cuelake.llm import language_id

    docs = common.table(spark, sf_dir, "documents")
    learned = docs.select("doc_id", "text", "lang").where(common.bucket("doc_id", 4) != 2)
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(learned), keep=["doc_id"])
    return out.select("doc_id", (common.bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_hilbert_neighbours, op3_simhash, op4_suffix_dedup, op5_pii, op6_quality, op7_decontaminate, op8_html_text, op9_token_files, op10_language, pipeline)}
ORACLE_SQL: dict[str, str] = {}
