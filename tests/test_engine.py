"""Caption files to answers, end to end."""

import pytest
from pyspark.sql import functions as F

from cuelake.config import Config
from cuelake.plans.engine import Engine, build_documents
from cuelake.sources import vtt

TEXTS = {
    "english/aaa.en.vtt": ["The ministry of fisheries opened a new harbour", "Boats from the whole coast came to see it"],
    "english/bbb.en.vtt": ["Machine learning helps doctors read scans", "Doctors remain responsible for every diagnosis"],
    "russian/bbb.ru.vtt": ["Врачи читают снимки с помощью машин"],
    "mixed/ccc.vtt": ["Snow fell on the mountain villages last night"],
}


def write(root, name, lines):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("WEBVTT\n\n" + "\n\n".join(f"00:00:{5 * i:02d}.000 --> 00:00:{5 * i + 4:02d}.000\n{t}" for i, t in enumerate(lines)))


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    for name, lines in TEXTS.items():
        write(root, name, lines)
    (root / "bad.vtt").write_text("not captions")
    (root / "silent.en.vtt").write_text("WEBVTT\n\n")
    return root


def test_pipeline(spark, archive, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", Config().override(**{"hybrid.enabled": True, "top_k": 2}))
    assert e.ingest(str(archive)) == {"new": 6}
    assert e.documents.where("not is_speech_free").count() == 4
    assert {r.language for r in e.documents.collect()} == {"en", "ru"}
    first = e.build_index()
    assert e.info() == {"documents": 5, "files": 5, "videos": 5, "speech_free": 1, "points": 5}
    q = spark.createDataFrame([(1, "who reads scans with machine learning"), (2, "harbour for boats")], "query_id long, text string")
    hits = {(r.query_id, r["rank"]): r.path for r in e.retrieve(q).collect()}
    assert "bbb.en" in hits[(1, 1)] and "aaa.en" in hits[(2, 1)] and len(hits) == 4
    answers = {r.query_id: r for r in e.ask(q, as_of=F.lit("2024-02-01").cast("date"), exclude_speech_free=True).collect()}
    assert "Machine learning" in answers[1].answer and answers[2].prompt.startswith("Context from video transcripts:\n[Document 1]") and answers[2].prompt.endswith("Question: harbour for boats")
    records = e.documents.where("path like '%aaa%'").select(F.lit(2).cast("long").alias("query_id"), F.lit("harbour for boats").alias("query"), F.array("id").alias("relevant_doc_ids"))
    assert {r.metric: r.mean for r in e.evaluate(records).collect()}["mrr"] == 1.0

    write(archive, "english/aaa.en.vtt", ["The harbour closed again"])
    (archive / "mixed/ccc.vtt").unlink()
    write(archive, "english/ddd.en.vtt", ["Volcano on the island wakes"])
    states = e.ingest(str(archive))
    assert states["modified"] == 1 and states["deleted"] == 1 and states["new"] == 2  # the invalid file never gets an entry
    assert {r.path.rsplit("/", 1)[1] for r in e.documents.collect()} == {"aaa.en.vtt", "bbb.en.vtt", "bbb.ru.vtt", "ddd.en.vtt", "silent.en.vtt"}
    assert e.build_index() != first and e.index.info("live")[0] == 5
    source = e.documents.where("path like '%ddd%'").first().id
    assert source not in {r.doc_id for r in e.related(source, 3).collect()}


@pytest.mark.parametrize("merge", ["coverage", "diverse_rrf"])
def test_variants(spark, archive, tmp_path, merge):
    e = Engine(spark, f"file://{tmp_path}/db", Config().override(**{"two_stage.enabled": True, "two_stage.merge": merge, "two_stage.order": "book_end", "reranker.enabled": True}))
    e.ingest(str(archive))
    e.build_index()
    q = spark.createDataFrame([(1, "snow in villages")], "query_id long, text string")
    v = spark.createDataFrame([(1, 1, "mountain villages snow night"), (1, 2, "harbour")], "query_id long, variant int, text string")
    assert "Snow fell" in e.ask(q, variants=v, k=3).first().answer


def test_metadata(spark, archive):
    articles = spark.createDataFrame([("aaa", "Harbour", "2024-01-02T00:00:00Z", "https://e.org/a", "<b>All</b> about &amp; around it", ""), ("silent", "Music", None, "", "An hour of music without a single spoken word, recorded in the old town hall", "")], "video_hash string, name string, date_active_start string, url string, preview_text string, detail_text string")
    files = vtt.scan(spark, str(archive))
    docs = {r.video_hash: r for r in build_documents(files, Config().override(**{"metadata.include_in_text": True}), articles).collect()}
    assert docs["aaa"].text.endswith("Title: Harbour\nDate: 2024-01-02\nDescription: All about & around it\nURL: https://e.org/a") and docs["aaa"].date == "2024-01-02"
    assert docs["silent"].is_speech_free and docs["silent"].content_hash is None and "hour of music" in docs["silent"].text
    only = build_documents(files, Config().override(**{"metadata.required": True}), articles)
    assert {r.video_hash for r in only.collect()} == {"aaa", "silent"}


@pytest.mark.parametrize("strategy", ["time", "token", "hybrid"])
def test_strategies(spark, archive, strategy):
    docs = build_documents(vtt.scan(spark, str(archive)), Config().override(**{"chunking.strategy": strategy}))
    assert docs.where("is_chunk").count() == 4 and docs.select("total_chunks").where("total_chunks = 1").count() == 4
