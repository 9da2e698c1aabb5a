"""The whole way: caption files to an index, questions to prompts, records to metrics.

Nothing here runs a query at a time: questions are a table, and every step is a plan over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.config import Config
from cuelake.functions import text as X
from cuelake.functions import web as H
from cuelake.operators import bm25, chunking, fusion, incremental, metadata, metrics, models, prompt, ranking, vector
from cuelake.sources import readers, sinks, vtt

#: Variants of a question at most, with itself; their number is a bit in a mask. More are an error.
MAX_VARIANTS = 63


def build_documents(files: DataFrame, config: Config, articles: DataFrame | None = None) -> DataFrame:
    """files: path, content (as scanned). Index documents with ids, hashes and, if there are articles, their metadata.

    A valid file without speech becomes one document of its article's description; an invalid one becomes none.
    """
    c = config.chunking
    good = files.where(vtt.is_valid(F.col("content"))).select("path", X.detect_language(F.col("path")).alias("language"), X.video_hash(F.col("path")).alias("video_hash"))
    cued = good.join(chunking.cues_of(vtt.parse(files)), "path", "left")
    language = F.col("language")
    made = {
        "time": lambda q: chunking.by_time(q, c.duration, c.overlap),
        "token": lambda q: chunking.by_tokens(q, language, c.max_tokens, c.min_tokens),
    }.get(c.strategy, lambda q: chunking.hybrid(q, language, c.duration, c.overlap, c.max_tokens, c.min_tokens))
    empty = F.expr(f"cast(array() as {chunking.CUE})")
    docs = chunking.documents(cued.withColumn("cues", F.coalesce("cues", empty)), made(F.col("cues"))).join(good.select("path", "video_hash"), "path")
    if articles is None:
        for f in metadata.WEB_FIELDS:
            docs = docs.withColumn(f, F.lit(None).cast("double" if f == "web_date_ts" else "string"))
        return docs.withColumn("date", F.lit(None).cast("string"))
    docs = metadata.attach(docs, H.clean_metadata(articles), config.metadata.required)
    block = H.metadata_block(config.metadata.fields, config.metadata.label)
    text = H.append_metadata(F.col("text"), block, language, config.chunking.max_tokens) if config.metadata.include_in_text else F.col("text")
    text = F.when(F.col("is_speech_free"), F.coalesce("web_description", "web_title", F.lit(""))).otherwise(text)
    docs = docs.withColumn("text", text).withColumn("length", F.length("text")).withColumn("content_hash", F.when(~F.col("is_speech_free"), X.content_hash(F.col("text"))))
    return docs.withColumn("date", F.col("web_date")).where(~F.col("is_speech_free") | (F.length("text") >= 50))


class Engine:
    """Tables under a root folder: documents, manifest and the vector index (an alias that versions swap under)."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder=models.embed, scorer=models.overlap, answerer=models.extract_answer):
        """embedder: of a text column; scorer and answerer: of question and text. `models.provider` makes them of clients."""
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.embedder, self.scorer, self.answerer = embedder, scorer, answerer
        self.index = sinks.Collections(spark, f"{self.root}/index")

    # --- Building -----------------------------------------------------------------------------------------------------

    @property
    def documents(self) -> DataFrame:
        return sinks.read(self.spark, f"{self.root}/documents")

    def ingest(self, folder: str, articles: DataFrame | None = None) -> dict[str, int]:
        """Reads a folder of caption files; only new and modified ones are parsed again. Counts of files by state."""
        for name in ("documents", "manifest", "states"):
            sinks.recover(self.spark, f"{self.root}/{name}")
        files = vtt.scan(self.spark, folder)
        old = readers.manifest(self.spark, f"{self.root}/manifest")
        states = incremental.classify_files(old, files)
        sinks.publish(states, f"{self.root}/states")
        states = self.spark.read.parquet(f"{self.root}/states")
        todo = files.join(states.where(F.col("state").isin("new", "modified")).select("path"), "path", "left_semi")
        fresh = build_documents(todo, self.config, articles)
        if old.limit(1).count():
            gone = self.documents.join(states.where(F.col("state").isin("deleted", "modified")).select("path"), "path", "left_semi").select("id")
            fresh = incremental.updated_documents(self.documents, gone, fresh.select(*self.documents.columns), "id")
        sinks.publish(fresh, f"{self.root}/documents")
        ids = self.documents.select("path", F.col("id").alias("doc_id"))
        sinks.publish(incremental.updated_manifest(old, states, files, ids), f"{self.root}/manifest")
        return {r.state: r["count"] for r in states.groupBy("state").count().collect()}

    def embed(self) -> DataFrame:
        """Documents with vectors; those whose content is in the index already keep theirs."""
        docs = self.documents
        if not self.index.exists("_alias_live"):
            return docs.withColumn("embedding", self.embedder(F.col("text")))
        cache = self.index.read("live").select(F.lit(0).alias("row"), "text", "content_hash", "embedding")
        hits, misses = incremental.cached_embeddings(docs, cache)
        return hits.unionByName(misses.withColumn("embedding", self.embedder(F.col("text"))))

    def build_index(self, size: int = models.DIMENSION, distance: str = "Cosine") -> str:
        """A new version of vectors and of their texts' postings."""
        version = self.index.swap("live", self.embed().withColumn("point_id", X.point_id(F.col("id"))), size, distance)
        old = sinks.folders(self.spark, f"{self.root}/words")
        self._postings(version)
        for name in old:
            sinks.delete(self.spark, f"{self.root}/words/{name}")
        return version

    def _postings(self, version: str) -> bm25.Index:
        """The stored postings of a version; made if they are not there in full."""
        path = f"{self.root}/words/{version}"
        if sinks.exists(self.spark, f"{path}/stats/_SUCCESS"):
            return bm25.load(self.spark, path)
        return bm25.build(self.index.read(version).select(F.col("id").alias("doc_id"), "text"), path)

    def info(self) -> dict[str, int]:
        d = self.documents.agg(F.count("*").alias("documents"), F.count_distinct("path").alias("files"), F.count_distinct("video_id").alias("videos"), F.count_if("is_speech_free").alias("speech_free")).first()
        return d.asDict() | {"points": self.index.info("live")[0]}

    # --- Asking -------------------------------------------------------------------------------------------------------

    def retrieve(self, questions: DataFrame, k: int | None = None, variants: DataFrame | None = None, start: Column | None = None, end: Column | None = None, exclude_speech_free: bool = False) -> DataFrame:
        """questions: query_id (long), text. variants: query_id, variant (1 to 62), text, besides the question itself.

        query_id, doc_id, score, rank, after fusion, merging and filters.
        """
        c, k = self.config, k or self.config.top_k
        pool = self.index.read("live")
        fetch = ranking.overfetch(k, c.hybrid.enabled, c.hybrid.multiplier, start is not None or end is not None, exclude_speech_free)
        asked = questions.select("query_id", F.lit(0).cast("long").alias("variant"), "text")
        if variants is not None and c.two_stage.enabled:
            if variants.where(F.col("variant").isNull() | ~F.col("variant").between(1, MAX_VARIANTS - 1)).limit(1).count():
                raise ValueError(f"variants are numbered from 1 to {MAX_VARIANTS - 1}")
            asked = asked.unionByName(variants.select("query_id", F.col("variant").cast("long"), "text"))
        lists = asked.select((F.col("query_id") * 64 + F.col("variant")).alias("query_id"), "text")
        base = pool.select(F.col("id").alias("doc_id"), "embedding", "text")
        near = vector.knn(lists.withColumn("embedding", self.embedder(F.col("text"))), base, fetch)
        if c.hybrid.enabled:
            words = bm25.search(lists, None, fetch, self._postings(self.index.resolve("live")))
            near = fusion.rrf(words, near, k=c.hybrid.rrf_k, limit=fetch) if c.hybrid.method == "rrf" else fusion.weighted(near, words, c.hybrid.bm25_weight, limit=fetch)
        split = near.select(F.floor(F.col("query_id") / 64).cast("long").alias("query_id"), (F.col("query_id") % 64).alias("variant"), "doc_id", "score", "rank")
        if variants is None or not c.two_stage.enabled:
            merged = split.drop("variant")
        elif c.two_stage.merge == "coverage":
            merged = fusion.coverage(split, fetch).select("query_id", "doc_id", "score", "rank")
        else:
            merged = fusion.diverse_rrf(split, c.two_stage.merge_rrf_k, fetch)
        hits = merged.join(pool.drop("embedding", "distance").withColumnRenamed("id", "doc_id"), "doc_id")
        if exclude_speech_free:
            hits = ranking.without_speech_free(hits)
        if start is not None or end is not None:
            hits = ranking.date_range(hits.withColumn("date", X.date_of(F.coalesce(F.nullif(F.col("web_date"), F.lit("")), F.col("date")))), start, end)
        return hits.where(F.col("rank") <= (c.reranker.initial_k if c.reranker.enabled else k))

    def ask(self, questions: DataFrame, as_of: Column | None = None, **options) -> DataFrame:
        """query_id, question, prompt and the stand-in's answer. Recent questions prefer recent documents."""
        c = self.config
        k = options.get("k") or c.top_k
        hits = self.retrieve(questions, **options).join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        if as_of is not None:
            recent = X.time_sensitivity(F.col("question")) == "recent"
            date = X.date_of(F.coalesce(F.nullif(F.col("web_date"), F.lit("")), F.col("date").cast("string")))
            hits = ranking.time_decay(hits.withColumn("date", F.when(recent, date)), as_of).drop("rank").withColumnRenamed("final_rank", "rank").withColumn("date", F.date_format(date, "yyyy-MM-dd"))
        if c.reranker.enabled:
            hits = ranking.rerank(hits, self.scorer(F.col("question"), F.col("text")), k)
            hits = ranking.threshold(hits, c.reranker.least)
        placed = ranking.prompt_order(hits, c.two_stage.order if c.two_stage.enabled else "rank")
        rows = placed.withColumn("date", F.coalesce(F.nullif(F.col("web_date"), F.lit("")), F.col("date").cast("string"))).withColumn("duration_seconds", F.lit(None).cast("double"))
        texts = prompt.context(rows, ("query_id", "question"), order="place")
        best = placed.groupBy("query_id").agg(F.min_by("text", "rank").alias("best"))
        out = texts.join(best, "query_id")
        return out.select("query_id", "question", prompt.user_message(F.col("context"), F.col("question")).alias("prompt"), self.answerer(F.col("question"), F.col("best")).alias("answer"))

    def related(self, doc_id: str, k: int = 5, same_video: bool = False) -> DataFrame:
        return vector.related(self.index.read("live").select(F.col("id").alias("doc_id"), "embedding", "video_id"), doc_id, k, same_video)

    # --- Measuring ----------------------------------------------------------------------------------------------------

    def evaluate(self, records: DataFrame, ks: tuple[int, ...] = metrics.KS) -> DataFrame:
        """records: query_id (long), query, relevant_doc_ids. metric, mean, p10, p25."""
        hits = self.retrieve(records.select("query_id", F.col("query").alias("text")), k=max(ks))
        qrels = records.select("query_id", F.explode("relevant_doc_ids").alias("doc_id"))
        return metrics.summary(metrics.retrieval_metrics(hits, qrels, ks))
