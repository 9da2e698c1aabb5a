"""Hand-computed cases and plain Python versions of the operators."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions import text as X
from cuelake.functions import web as H
from cuelake.operators import bm25, chunking, fusion, incremental, metrics, models, ranking, vector
from cuelake.sources import readers, sinks, vtt


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def parsed(spark, content):
    return rows(vtt.parse(spark.createDataFrame([("f", content)], "path string, content string")), "rn")


def test_vtt_english(spark):
    text = "WEBVTT\n\n00:00:00.000 --> 00:00:05.000\n<v Ann>Good morning\n\n00:00:05.000 --> 00:00:10.000\nall\nof you\n\n00:00:10.000 --> 00:00:15.000\nbye"
    got = parsed(spark, text)
    assert [(r[2], r[3], r[6]) for r in got] == [("00:00:00", "00:00:05", "Good morning"), ("00:00:05", "00:00:10", "all of you"), ("00:00:10", "00:00:15", "bye")]


def test_vtt_ids_and_notes(spark):
    text = "WEBVTT\n\n1\n00:00:01.900 --> 00:00:02.000\n<c.y>Привет</c>\n\nNOTE nothing\n\nabc-2\n00:00:03.000 --> 00:00:04.000 align:start\n12\n\n3\n00:00:05.000 --> 00:00:06.000\n<i></i>"
    assert [(r[4], r[5], r[6]) for r in parsed(spark, text)] == [(1.0, 2.0, "Привет"), (3.0, 4.0, "12")]


def test_vtt_invalid_and_silent(spark):
    df = spark.createDataFrame([("a", "no header\n"), ("b", "WEBVTT\n\n"), ("c", "")], "path string, content string")
    assert vtt.parse(df).count() == 0
    assert dict(rows(df.select("path", vtt.is_valid(F.col("content"))), "path")) == {"a": False, "b": True, "c": False}


def cue_files(spark, cues, lang="en"):
    data = [("f", i, X_stamp(a), X_stamp(b), float(a), float(b), t) for i, (a, b, t) in enumerate(cues)]
    df = spark.createDataFrame(data, "path string, rn int, start_time string, end_time string, start_s double, end_s double, text string")
    return chunking.cues_of(df).withColumn("lang", F.lit(lang))


def X_stamp(s):
    return f"{int(s) // 3600:02d}:{int(s) % 3600 // 60:02d}:{int(s) % 60:02d}"


def chunked(files, column):
    return [r.asDict() for r in chunking.exploded(files, column, "path").orderBy("chunk_index", "start_s").collect()]


def test_time_chunks_gap(spark):
    f = cue_files(spark, [(0, 5, "a"), (120, 125, "b"), (360, 365, "c")])
    got = chunked(f, chunking.by_time(F.col("cues"), 300, 0))
    assert [(c["start_s"], c["text"]) for c in got] == [(0.0, "a b"), (360.0, "c")]


def test_time_chunks_overlap(spark):
    f = cue_files(spark, [(270, 280, "a"), (290, 300, "b"), (315, 320, "c")])
    got = chunked(f, chunking.by_time(F.col("cues"), 300, 30))
    assert [c["start_s"] for c in got] == [270.0, 270.0]


def test_hybrid_multi(spark):
    f = cue_files(spark, [(0, 5, "first words here now"), (300, 305, "second words here now"), (600, 605, "third words here now")])
    assert len(chunked(f, chunking.hybrid(F.col("cues"), F.col("lang"), 300, 30, 500, 5))) == 3


def plain_hybrid(cues, duration, overlap, most, least, ratio):
    """The definition, step by step."""
    tok = lambda t: int(len(t) / ratio)
    make = lambda cs: dict(t=" ".join(c[2] for c in cs), a=cs[0][0], b=cs[-1][1], n=len(cs))
    windows, begin, held = [], 0.0, []
    for c in cues:
        if c[0] >= begin + duration:
            if held:
                windows.append(make(held))
            begin += duration - overlap
            held = [h for h in held if h[0] >= begin]
        held = held + [c]
    if held:
        windows.append(make(held))
    parts = []
    for w in windows:
        if tok(w["t"]) <= most:
            parts.append(w)
            continue
        group, size = [], 0
        for c in (c for c in cues if w["a"] <= c[0] < w["b"]):
            t = tok(c[2])
            if t > most:
                if group:
                    parts.append(make(group))
                parts.append(make([c]))
                group, size = [], 0
            elif group and size + t + 1 > most:
                parts.append(make(group))
                group, size = [c], t
            else:
                group, size = group + [c], size + t + 1
        if group:
            parts.append(make(group))
    join = lambda p, q: dict(t=p["t"] + " " + q["t"], a=p["a"], b=q["b"], n=p["n"] + q["n"])
    out, i = [], 0
    while i < len(parts):
        c = parts[i]
        if tok(c["t"]) < least:
            if out and tok(out[-1]["t"] + " " + c["t"]) <= most:
                out[-1] = join(out[-1], c)
                i += 1
                continue
            if i + 1 < len(parts) and tok(c["t"] + " " + parts[i + 1]["t"]) <= most:
                out.append(join(c, parts[i + 1]))
                i += 2
                continue
        out.append(c)
        i += 1
    return [(p["t"], p["a"], p["b"], p["n"]) for p in out]


@pytest.mark.parametrize("seed", range(6))
def test_hybrid_against_plain(spark, seed):
    import random

    rng = random.Random(seed)
    cues, at = [], 0.0
    for _ in range(60):
        at += rng.choice([3, 10, 40, 200])
        cues.append((at, at + 2, " ".join("word" for _ in range(rng.choice([1, 5, 30, 90])))))
    f = cue_files(spark, cues)
    got = [(c["text"], c["start_s"], c["end_s"], c["cue_count"]) for c in [r.asDict() for r in f.select(F.posexplode(chunking.hybrid(F.col("cues"), F.col("lang"), 120, 20, 60, 25)).alias("i", "c")).orderBy("i").select("c.*").collect()]]
    assert got == plain_hybrid(cues, 120, 20, 60, 25, 4.0)


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "machine learning is fun"), (2, "cooking with fire"), (3, "learning to swim")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "machine learning"), (2, "nothing matches-this")], "query_id long, text string")
    got = rows(bm25.search(q, docs, 3), "query_id", "rank")
    assert got[0][:2] == (1, 1) and len(got) == 6
    assert [g[2] for g in got[3:]] == [0.0] * 3 and [g[1] for g in got[3:]] == [1, 2, 3]


def hits(spark, data, cols="query_id long, doc_id long, rank int, score double"):
    return spark.createDataFrame(data, cols)


def test_rrf_and_weighted(spark):
    v, b = hits(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.5)]), hits(spark, [(1, 2, 1, 10.0), (1, 3, 2, 3.0)])
    got = rows(fusion.rrf(v, b), "rank")
    assert [g[1] for g in got] == [2, 1, 3] and math.isclose(got[0][2], 1 / 62 + 1 / 61, abs_tol=1e-8)
    assert rows(fusion.weighted(v, b, 0.1), "rank")[0][1] == 1
    assert rows(fusion.weighted(v, b, 0.9), "rank")[0][1] == 2


def test_coverage_and_diverse(spark):
    v = hits(spark, [(1, 0, 10, 0.9, 1), (1, 0, 11, 0.5, 2), (1, 1, 12, 0.8, 1), (1, 1, 11, 0.4, 2)], "query_id long, variant long, doc_id long, score double, rank int")
    got = rows(fusion.coverage(v, 3), "rank")
    assert [g[2] for g in got] == [11, 10, 12] and got[0][3] == 0.5
    d = hits(spark, [(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 1, 1), (1, 1, 3, 2)], "query_id long, variant long, doc_id long, rank int")
    assert [g[1] for g in rows(fusion.diverse_rrf(d), "rank")] == [1, 2, 3]


@pytest.mark.parametrize(
    ("found", "relevant", "metric", "value"),
    [("axy", "ab", "recall@3", 0.5), ("ax", "a", "precision@3", round(1 / 3, 6)), ("xac", "a", "mrr", 0.5), ("xa", "a", "ndcg@3", round(1 / math.log2(3), 6)), ("axb", "ab", "map", round(5 / 6, 6)), ("xy", "a", "map", 0.0)],
)
def test_metrics(spark, found, relevant, metric, value):
    h = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(found)], "query_id long, doc_id string, rank int")
    q = spark.createDataFrame([(1, d) for d in relevant], "query_id long, doc_id string")
    got = {r.metric: r.value for r in metrics.retrieval_metrics(h, q).collect()}
    assert got[metric] == value


def test_metrics_without_relevant(spark):
    h = spark.createDataFrame([(1, "a", 1)], "query_id long, doc_id string, rank int")
    q = spark.createDataFrame([], "query_id long, doc_id string")
    assert {r.value for r in metrics.retrieval_metrics(h, q).collect()} == {0.0}


def test_prompt_orders(spark):
    for n, ends in ((2, [1, 2]), (3, [1, 3, 2]), (4, [1, 3, 4, 2])):
        h = hits(spark, [(1, i, i, 1.0 / i) for i in range(1, n + 1)])
        assert [r.doc_id for r in ranking.prompt_order(h, "book_end").orderBy("place").collect()] == ends
        assert [r.doc_id for r in ranking.prompt_order(h, "reversed").orderBy("place").collect()] == list(range(n, 0, -1))


def test_overfetch():
    assert ranking.overfetch(3, hybrid=True, multiplier=5) == 15
    assert ranking.overfetch(5, related=True) == 6 and ranking.overfetch(5, related=True, same_video=True) == 15


def test_index_diff(spark):
    old = spark.createDataFrame([("1", "h1"), ("old", "hold")], "point_id string, content_hash string")
    new = spark.createDataFrame([("1", "h1"), ("2", "h2")], "point_id string, content_hash string")
    assert tuple(incremental.diff_stats(incremental.index_diff(old, new)).first()) == (2, 1, 1, 1)
    assert {r.point_id for r in sinks.apply_diff(old, new).collect()} == {"1", "2"}


def test_legacy_ids(spark):
    good = spark.createDataFrame([("a1b2c3d4-e5f6-7890-abcd-ef1234567890",)], "point_id string")
    assert not incremental.has_legacy_ids(good) and incremental.has_legacy_ids(good.union(spark.createDataFrame([("17",)], "point_id string")))


def test_uuid(spark):
    import uuid

    got = spark.range(1).select(X.point_id(F.lit("doc-ü"))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(X.NAMESPACE), "doc-ü"))


def test_collections(spark, tmp_path):
    c = sinks.Collections(spark, f"file://{tmp_path}/index")
    v = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, embedding array<float>")
    first = c.swap("live", v, 2, "Unknown")
    second = c.swap("live", v.union(spark.createDataFrame([("b", [0.0, 1.0])], v.schema)), 2)
    assert c.names() == [second] and first != second and c.info("live") == (2, "green")
    assert c.read("live").first().distance == "Cosine"
    with pytest.raises(ValueError, match="components"):
        c.write("bad", v, 3)


def test_bm25_negative_floor(spark):
    """With a negative floor documents without a match come first, whatever k is; the whole order is that of all documents."""
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, "c"), (5, "a"), (6, "a b c")], "doc_id long, text string")
    d = d.where("doc_id < 5")
    q = spark.createDataFrame([(1, "a"), (2, "c"), (3, "none"), (4, "a c")], "query_id long, text string")
    whole = rows(bm25.search(q, d, 4), "query_id", "rank")
    assert [r[1] for r in whole if r[0] == 1] == [4, 1, 2, 3]
    for k in (1, 2, 3):
        assert rows(bm25.search(q, d, k), "query_id", "rank") == [r for r in whole if r[3] <= k]


def test_bm25_stored(spark, tmp_path):
    d = spark.createDataFrame([(i, f"word{i % 7} common word{i % 3}") for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "word5 common"), (2, "")], "query_id long, text string")
    index = bm25.build(d, str(tmp_path / "words"))
    assert rows(bm25.search(q, None, 5, index), "query_id", "rank") == rows(bm25.search(q, d, 5), "query_id", "rank")
    assert rows(bm25.search(q, None, 5, bm25.load(spark, str(tmp_path / "words"))), "query_id", "rank")[0][1] == 5
    assert bm25.search(q, d.where("false"), 5).count() == 0


def test_knn_ties_and_lengths(spark):
    """Ties across the cut go to the smaller id; vectors of another length and null ones take no part."""
    base = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(50, [2.0, 0.1]), (51, [1.0]), (52, None), (53, [0.0, 0.0])]
    b = spark.createDataFrame(base, "doc_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0]), (3, None)], "query_id long, embedding array<double>")
    got = [r[:3] for r in rows(vector.knn(q, b, 4, "dot"), "query_id", "rank")]
    assert got == [(1, 50, 2.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 51, 3.0)]
    assert [r[1] for r in rows(vector.knn(q, b, 3, "dot", skip_self=True), "query_id", "rank")] == [50, 2, 3, 51]
    assert vector.knn(q.where("false"), b, 3).count() == 0


def test_audio_boundaries_of_long_files(spark):
    """More than a thousand cuts."""
    d = spark.range(1).select(chunking.audio_boundaries(F.lit(90_000.0), F.array(F.lit(61.0)), 60.0, 5.0).alias("c")).first().c
    assert len(d) > 1400 and d[0] == 61.0 and d[-1] < 90_000


def test_publish_recovers(spark, tmp_path):
    """A swap that broke off between its renames is ended by the next reader: with the fresh table if it is whole, else with the old one."""
    path = str(tmp_path / "t")
    sinks.publish(spark.range(5), path)
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert sinks.read(spark, path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    spark.range(7).write.parquet(path + ".new-1")
    assert sinks.read(spark, path).count() == 7
    sinks.publish(spark.range(3), path)
    assert sinks.read(spark, path).count() == 3 and [p.name for p in tmp_path.iterdir() if "old" in p.name] == []


def test_publish_reads_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.publish(spark.range(5), path)
    sinks.publish(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_readers(spark, tmp_path):
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "h1.json").write_text(json.dumps({"name": "Title", "date_active_start": "2024-01-02T00:00:00Z", "url": "u", "preview_text": "a&nbsp;&amp; <b>b</b>", "detail_text": "", "extra": 1}))
    (folder / "h2.json").write_text("{broken")
    (folder / "h3.json").write_text(json.dumps({"name": " ", "preview_text": ""}))
    got = rows(H.clean_metadata(readers.web_metadata(spark, str(folder))), "video_hash")
    assert got == [("h1", "Title", "2024-01-02", 1704153600.0, "a & b", "u")]
    assert readers.video_hashes(spark, str(folder)).count() == 3
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", json.dumps([{"name": "1"}, {"name": "2"}]))
        z.writestr("b.json", "nope")
        z.writestr("c.json", json.dumps({"name": "3"}))
    assert sorted(r.name for r in readers.zip_export(spark, str(tmp_path / "x.zip")).collect()) == ["1", "2", "3"]
    (tmp_path / "s.csv").write_text("a,b\nc,\n,d\n")
    assert rows(readers.sheet_column(spark, str(tmp_path / "s.csv"), "B"), "row") == [(1, "b"), (3, "d")]
    assert readers.manifest(spark, str(tmp_path / "none")).count() == 0


def test_scan(spark, tmp_path):
    (tmp_path / "english").mkdir()
    (tmp_path / "english" / "h.en.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nhi\n")
    (tmp_path / "english" / "big.vtt").write_text("WEBVTT" + " " * 100)
    (tmp_path / "root.vtt").write_text("WEBVTT\n")
    f = vtt.scan(spark, str(tmp_path), 60)
    assert f.count() == 2 and vtt.parse(f).count() == 1
    known = spark.createDataFrame([("h",)], "video_hash string")
    assert vtt.scan_known(f, known).count() == 1


def test_metric_table(spark):
    m = spark.createDataFrame([("c", "recall@5", 0.5), ("c", "x", float("nan")), ("c", "y", float("inf"))], "condition string, metric string, value double")
    assert sinks.metric_table(m, ["condition"]).columns == ["condition", "recall_at_5"]


def test_limits():
    assert X.max_chunk_tokens("mistral-embed", 50) == 462 and X.max_chunk_tokens("x", 600) == 1 and X.max_chunk_tokens("x", explicit=9) == 9


def test_session_states(spark):
    from cuelake.streaming import windows

    assert callable(windows.session_states) and callable(windows.ingest)


def test_media_tokens(spark):
    import hashlib
    import hmac

    for secret in ("s", "é" * 50, "x" * 200):
        want = "v1.1700000000." + hmac.new(secret.encode(), b"1700000000", hashlib.sha256).hexdigest()[:32]
        d = spark.createDataFrame([(want,), (want[:-1] + "x",), ("v1.1700000000",), ("v2" + want[2:],), ("v1.abc." + want[-32:],), (None,), ("",)], "t string")
        assert d.select(X.media_token(F.lit(1700000000.9), secret)).first()[0] == want
        assert [r[0] for r in d.select(X.token_valid(F.col("t"), secret, F.lit(1699999999))).collect()] == [True] + [False] * 6
        assert not d.select(X.token_valid(F.col("t"), secret, F.lit(1700000000))).first()[0]
    assert spark.range(1).select(X.media_token(F.lit(1), "")).first()[0] == ""


def test_provider(spark):
    """Batches, retries of transient failures only, halved batches, nulls, several columns."""

    class Busy(Exception):
        status_code = 429

    seen = []

    def client(texts):
        seen.append(len(texts))
        if len(seen) in (1, 2):
            raise Busy("later")
        if len(texts) > 4:
            raise RuntimeError("CUDA out of memory")
        return [len(t) for t in texts]

    assert models.call_in_batches(client, ["x" * i for i in range(11)], 8, 2, 0.0) == list(range(11))
    assert seen == [8, 8, 8, 4, 4, 3]
    with pytest.raises(Busy):
        models.call_in_batches(lambda t: (_ for _ in ()).throw(Busy()), ["a"], 8, 2, 0.0)
    with pytest.raises(KeyError):
        models.call_in_batches(lambda t: {}["wrong"], ["a"], 8, 5, 0.0)
    with pytest.raises(ValueError):
        models.call_in_batches(lambda t: [], ["a"], 8, 5, 0.0)
    d = spark.createDataFrame([(0, "ab", "c"), (1, None, "c"), (2, "", None), (3, "abcd", "")], "i long, a string, b string")
    one = models.provider(lambda: lambda texts: [[float(len(t))] for t in texts], T.ArrayType(T.FloatType()), batch=2, prefix="query: ")
    two = models.provider(lambda: lambda pairs: [a + "/" + b for a, b in pairs], T.StringType())
    got = d.select("i", one(F.col("a")).alias("x"), two(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [([9.0], "ab/c"), (None, None), ([7.0], None), ([11.0], "abcd/")]


def test_human_bytes(spark):
    """Ties of the last place go to the even digit and no digit of a large size is lost, as in Python and in the SQL; null stays null."""
    g = 1024**3
    sizes = [0, 0.5, 1.5, 2.5, 1023.5, 1536, 2560, 3584, 1.5 * 1024**2, 2.5 * 1024**2, 1023.5 * 1024**2, -0.4, -2.5, 9932111872, 89389006848, 1.15 * g, 1.25 * g, 1.35 * g, 1.75 * g, 9.95 * g, 2.0**53 * g, 1e23 * g, 37.0 * 2.0**126]
    sizes += [(2 * i + 1) * g / 4 for i in range(2, 40)] + [(2 * i + 1) * g / 20 for i in range(10, 400)]
    unit = lambda n: f"{n:.0f} B" if n < 1024 else f"{n / 1024:.0f} KB" if n < 1024**2 else f"{n / 1024**2:.0f} MB" if n < g else f"{n / g:.1f} GB"
    got = spark.createDataFrame([(i, float(n)) for i, n in enumerate(sizes)] + [(-1, None)], "i int, n double").select("i", X.human_bytes(F.col("n")))
    assert rows(got, "i") == [(-1, None)] + [(i, unit(float(n))) for i, n in enumerate(sizes)]
