"""The pipeline's stages, each against what it must keep and drop."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from cuelake.llm import common, decontaminate, near_copies, pii, quality, queries, sentencepiece_ops, simhash
from cuelake.llm.sentencepiece_ops import decode_documents
from tests.conftest import SF
from tests.llm.test_operators import plain_containment


def plain_near_copies(texts):
    """For each text the first of those that links of a five-word Jaccard similarity of 0.8 or more join it with."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    holders, group = {}, list(range(len(texts)))
    for b, s in enumerate(sets):
        near = {a for x in s for a in holders.get(x, ())} if s else {a for a in range(b) if not sets[a]}
        for a in near:
            if len(sets[a] & s) >= 0.8 * len(sets[a] | s):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
        for x in s:
            holders.setdefault(x, []).append(b)
    return group


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]

    one = common.stored(corpus_pipeline.keep_quality(spark, docs, SF), "t")
    labels = common.table(spark, SF, "labels")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD} and one.columns == columns
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in one.collect()}) <= 0.02 * len(good)

    two = common.stored(corpus_pipeline.drop_near_duplicates(spark, one, SF), "t")
    rows = sorted(one.select("doc_id", "text").collect())
    want = {rows[g].doc_id for g in plain_near_copies([r.text for r in rows])}
    assert {r.doc_id for r in two.collect()} == want and two.count() == len(want) and two.columns == columns

    three = common.stored(corpus_pipeline.drop_contaminated(spark, two, SF), "t")
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").collect()]
    bad = {i for i, *_ in plain_containment([(r.doc_id, r.text) for r in two.collect()], items)}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad and three.columns == columns

    four = common.stored(corpus_pipeline.mask_personal_data(spark, three, SF), "t")
    assert four.columns == columns and four.count() == three.count()
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in four.collect())

    five = corpus_pipeline.encode(spark, four, SF)
    back = decode_documents(five.select("doc_id", "piece_ids"), queries.vocabulary(queries.WORD_MODEL))
    texts = {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == texts

    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_ids) for r in run.collect()) == sorted((r.doc_id, r.n_ids) for r in five.collect())


def test_stage_edges(spark):
    """Nulls, repeated rows, an empty table and clashing columns, whose values stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __score string, fp long, matches string, piece_ids string, n_ids string, rid long, __row long"
    names = [f.split()[0] for f in schema.split(", ")]
    one = lambda i, text, n: (i, text, "en", "s", len(text or ""), n / 10, f"s{n}", n, f"m{n}", f"p{n}", f"n{n}", n, -n)
    rows = [one(1, None, 1), one(2, "", 2), one(3, "some words of text", 3), one(3, "some words of text", 3), one(3, "another text under the same id", 5), one(None, "other words", 4), one(None, "and yet others", 6)]
    for data, kept in ((rows, [1, 3, 4, 5, 6]), ([], [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, SF), "edge")
            assert docs.columns == names + ["piece_ids_1", "n_ids_1"] * (name == "encoding")
        out = docs.collect()
        assert sorted(r.fp for r in out) == kept
        for r in out:
            assert (r["score"], r["__score"], r.matches, r.piece_ids, r.n_ids, r.rid, r["__row"]) == (r.fp / 10, f"s{r.fp}", f"m{r.fp}", f"p{r.fp}", f"n{r.fp}", r.fp, -r.fp)
            assert len(r.piece_ids_1) == 4 * r.n_ids_1 and bool(r.n_ids_1) == bool(r.text)
    assert simhash.near_duplicates(spark.createDataFrame(rows, schema)).where(F.col("component_id") == 3).count() == 3


def test_run_removes_its_tables(spark):
    before = common.left()
    corpus_pipeline.run(spark, SF)
    assert common.left() == before


@pytest.mark.parametrize("tile", [512, 8])
def test_near_copies(spark, monkeypatch, tile):
    """Against all pairs: planted copies with changed words, a chain of them, and texts that only share a passage."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "COLUMNS", tile * 16)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (7, 30, 60, 200, 900):
        base = rng.choice(words, n).tolist()
        for changes in (0, 0, 1, 2, 4, 8, 16):
            copy = list(base)
            for i in rng.choice(n, min(changes, n), replace=False):
                copy[i] = str(rng.choice(words))
            texts.append(" ".join(copy))
        texts += [" ".join(base[: n // 2] + rng.choice(words, n // 2).tolist()), " ".join(base[: n - 1])]
    chain = rng.choice(words, 300).tolist()
    for i in range(0, 120, 6):
        chain[i * 2] = "changed"
        texts.append(" ".join(chain))
    group = plain_near_copies(texts)
    far = sum(bin(simhash.fingerprint(texts[g]) ^ simhash.fingerprint(t)).count("1") > simhash.RADIUS for g, t in zip(group, texts))
    assert far > 10 and len(set(group)) > 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == set(group)


@pytest.mark.parametrize("without", ["by_bands", "by_fingerprint"])
def test_near_copies_by_fingerprints(spark, monkeypatch, without):
    """Fingerprints alone link all near copies within their radius, bands alone the rest too."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [""]
    for n in (40, 90, 200, 300):
        base = rng.choice(words, n).tolist()
        for changes in (0, 0, 1, 1, n // 60, n // 50, n // 40):
            copy = list(base)
            for i in rng.choice(n, changes, replace=False):
                copy[i] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(40)]
    monkeypatch.setattr(near_copies, without, lambda _: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    want, sets = plain_near_copies(texts), [set(near_copies.shingles(t).tolist()) for t in texts]
    if without == "by_bands":
        fps = [simhash.majority(near_copies.shingles(t)) for t in texts]
        near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= near_copies.RADIUS
        family = plain_groups(len(texts), near)
        linked = plain_groups(len(texts), lambda a, b: sets[a] == sets[b] or family[a] == family[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
        assert sum(g != i for i, g in enumerate(linked)) >= 0.8 * sum(g != i for i, g in enumerate(want))
        want = linked
    assert [got[i] for i in range(len(texts))] == want


def plain_groups(n, linked):
    """For each number the smallest that links join it with."""
    group = list(range(n))
    for b in range(n):
        for a in range(b):
            if group[a] != group[b] and linked(a, b):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_wide_cells(spark):
    """A wide radius, with few cells and several tiles, against all pairs."""
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)] + [0, 1, (1 << 64) - 1]
    for x in fps[:100]:
        for bit in rng.choice(64, int(rng.integers(6, 15)), replace=False).tolist():
            x ^= 1 << bit
        fps.append(x)
    rows = spark.createDataFrame([(simhash.signed(x), i) for i, x in enumerate(fps)], "fp long, rep long").repartition(3)
    want = plain_groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 11)
    for tile, width, most in ((8, 12, 0), (8, 12, 4), (64, 5, 0)):
        edges = {(r.a, r.b) for r in simhash.link_forest(rows, 11, tile, width, most).collect()}
        assert plain_groups(len(fps), lambda a, b: (a, b) in edges or (b, a) in edges) == want
    assert len(set(want)) < len(fps) - 40


@pytest.fixture
def rows_dealt(spark, monkeypatch):
    """Numbers of the rows that were dealt out by a key."""
    kind, seen = type(spark.range(0)), []
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *by: seen.append(self.count()) or plain(self, *by))
    return seen


def test_fingerprints_dealt_grow_with_the_table(spark, rows_dealt):
    """Eight times the fingerprints are dealt out as eight times the rows."""
    for n in (8000, 64000):
        near_copies.by_fingerprint(spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("fp")))
    assert rows_dealt[1] <= 9 * rows_dealt[0]


def test_near_copies_of_a_large_group(spark, monkeypatch, rows_dealt):
    """A group whose texts are linked is not compared with itself again; texts beside it are compared with all of it."""
    monkeypatch.setattr(near_copies, "TILE", 8)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(5, 245, 2)]
    texts += [" ".join(base[:k] + [f"x{k}-{i}" for i in range(300 - k)]) for k in (100, 200, 260)]
    ids = [int(i) for i in rng.permutation(len(texts))]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    sizes = spark.createDataFrame([(i, len(near_copies.shingles(t))) for i, t in zip(ids, texts)], "doc_id long, n long")
    edges = spark.createDataFrame([(0, i) for i in range(1, len(texts))], "a long, b long")
    got = {(r.a, r.b) for r in near_copies.verified(edges, sizes, rows).collect()}
    at = dict(zip(ids, texts))
    want = plain_near_copies([at[i] for i in range(len(at))])
    assert plain_groups(len(at), lambda a, b: (a, b) in got or (b, a) in got) == want and 1 < len(set(want)) < 5
    assert max(rows_dealt) < 4 * len(at)


def test_links_of_a_full_tile():
    """Memory stays that of the counts when every pair of a tile is linked."""
    sets = [np.arange(i % 3, 60 + i % 2, dtype=np.uint64) for i in range(1200)]
    tracemalloc.start()
    a, b = near_copies.links(sets, np.arange(1200), np.zeros(1200, int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == len(b) == 1199 and len({*a, *b}) == 1200 and peak < 40e6


def test_batches_for_workers_are_bounded_by_bytes(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id doc_id", "repeat('word ', if(id = 7, 2000000, 1600)) text")
    out = common.map_texts(docs, "text", lambda: lambda texts: {"n": list(map(len, texts))}, [T.StructField("n", T.LongType())], ["doc_id"])
    assert {(r.doc_id, r.n) for r in out.collect()} == {(i, 10_000_000 if i == 7 else 8000) for i in range(3000)}
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "rows long, bytes long").collect()
    assert sum(r.rows for r in sizes) == 3000 and all(r.bytes < 2 * common.BATCH_BYTES for r in sizes if r.bytes < 10_000_000)
    assert len(sizes) > 5


def test_workers_forget_what_other_stages_remembered():
    common.begin(quality.__name__)
    quality.counts("some words")
    common.begin(quality.__name__)
    assert "some" in quality._WORDS
    common.begin(decontaminate.__name__)
    decontaminate.hashes(["some", "words"])
    assert not quality._WORDS and decontaminate._HASHES
    sentencepiece_ops._LOADED[b"key"] = None
    common.begin(near_copies.__name__)
    assert not decontaminate._HASHES and not sentencepiece_ops._LOADED
