"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.llm import common, decontaminate, hilbert, html_text, induced, language_id, pii, quality, queries, simhash, suffix_dedup, token_files
from cuelake.llm.components import connected_components
from cuelake.llm.sentencepiece_ops import PieceModel, decode_documents, encode_documents
from tests.conftest import SF

ODD = ["", " ", None, "a", "\n\n", "Ünï ﬁ 🎉 日本", "x " * 3000, "same text here twice", "same text here twice", " lead  double\t\ttab ", "▁mark", "é" * 500, "12345 " * 50, "<|endoftext|> in text", "it's we'll I'd", "a\x00b\x1cc\x85d"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns that clash with the operators' own."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, 1.5, i) for i, t in enumerate(ODD)]
    rows += [rows[7], rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rid long")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


def got(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


# --- 1 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    with open(queries.vocabulary(queries.WORD_MODEL), "rb") as f:
        return PieceModel(f.read())


def test_pieces_equal_library(pieces, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.WORD_MODEL))
    rng = np.random.default_rng(1)
    letters = list("ab the ing  \n\t▁éß🎉日本 0123.,!er on")
    texts = [t for _, t in documents] + [t for t in ODD if t] + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + [" " * k + "x" + " " * j for k in range(36) for j in range(3)]
    texts += ["".join(pieces.pieces[i].replace("▁", " ") for i in rng.integers(260, 9000, 6)) for _ in range(1000)]
    for text, want, ids in zip(texts, lib.encode(texts), pieces.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_pieces_round_trip(spark, odd):
    path = queries.vocabulary(queries.WORD_MODEL)
    out = encode_documents(odd, path, decode=True)
    assert set(odd.columns) <= set(out.columns)
    for r in out.collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
    again = decode_documents(out.select("piece_ids"), path)
    assert again.count() == odd.count()


def test_unigram_search_is_best(pieces):
    """The Viterbi mode against all segmentations of short words."""
    m = PieceModel.__new__(PieceModel)
    m.pieces, m.scores = ["<unk>", "a", "b", "ab", "ba", "aba", "bb"], [0.0, -1.0, -1.2, -1.5, -1.6, -2.4, -2.0]
    m.vocab, m.longest = {p: i for i, p in enumerate(m.pieces) if i}, 3

    def best(w):
        if not w:
            return 0.0
        return max(m.scores[m.vocab[w[:i]]] + best(w[i:]) for i in range(1, min(3, len(w)) + 1) if w[:i] in m.vocab)

    words = sorted("".join(x) for n in range(1, 8) for x in __import__("itertools").product("ab", repeat=n))
    for w, ids in m._walk_unigram(words).items():
        assert "".join(m.pieces[i] for i in ids) == w and abs(sum(m.scores[i] for i in ids) - best(w)) < 1e-9


# --- 2 -----------------------------------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:900] = x[0]  # one vector holds a third of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = collections.defaultdict(list)
    for r in hilbert.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score, r["rank"]))
    hit = n = 0
    for q in range(0, 3000, 20):
        s = x[q].astype(float) @ x.T.astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        assert [r for _, _, r in out[q]] == list(range(1, 21))
        assert all(abs(s[v] - y) < 1e-9 for v, y, _ in out[q])
        hit += len(set(want.tolist()) & {v for v, _, _ in out[q]})
        n += 20
    assert hit / n >= 0.9


def test_neighbours_curves(spark, monkeypatch):
    """Recall where the curves restrict the search: 20,000 vectors without structure, 25 ranges, queries by tiles."""
    monkeypatch.setattr(hilbert, "ASKED", 64)
    monkeypatch.setattr(hilbert, "TILE", 500)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8)
    out = collections.defaultdict(set)
    for r in hilbert.search(df, F.col("vec_id") % 50 == 0).collect():
        out[r.query_id].add(r.vec_id)
    y = x.astype(np.float64)
    s = y[::50] @ y.T
    s[np.arange(400), np.arange(0, 20_000, 50)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(out[50 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.9


def test_neighbours_query(spark):
    """The query against brute force on its whole table."""
    rows = common.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    out = collections.defaultdict(list)
    for r in got(spark, "op2_hilbert_neighbours"):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(out) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hit = []
    for q, found in out.items():
        s = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(best) + 1))
        assert all(abs(y - s[ids == v][0]) < 1e-12 for _, v, y in found)
        assert [(-y, v) for _, v, y in sorted(found)] == sorted((-y, v) for _, v, y in found)
        hit.append(len(set(best) & {v for _, v, _ in found}) / len(best))
    assert np.mean(hit) >= 0.9


def test_neighbours_edges(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.5, None]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0])]
    out = [tuple(r) for r in hilbert.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert hilbert.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_curve_is_continuous():
    cells = np.array([[i, j] for i in range(16) for j in range(16)])
    order = cells[np.argsort(hilbert.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- 3 -----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    ids, x = list(fps), np.array(list(fps.values()), np.uint64)
    at = {i: i for i in ids}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for k in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[k] ^ x[:k]) <= 2):
            a, b = find(ids[k]), find(ids[j])
            at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, documents):
    out = {r["doc_id"]: r for r in got(spark, "op3_simhash")}
    fps = {i: plain_fingerprint(t) for i, t in documents}
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in out.items()} == plain_components(fps)


@pytest.mark.parametrize("tile", [5, 64, 10_000])
def test_simhash_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.array([s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in rng.integers(0, 63, (8, 2))] + [0, 1, 2**64 - 1], np.uint64)
    x = np.unique(x)
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(x.view(np.int64))], "fp long, rep long")
    comps = dict(tuple(r) for r in connected_components(simhash.link_forest(df, tile=tile)).collect())
    want = plain_components(dict(enumerate(x)))
    assert {i: comps.get(i, i) for i in want} == want


def test_simhash_edges(spark, odd):
    out = simhash.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[0].fp == by[1].fp == by[2].fp == 0 and by[2].component_id == 0 and by[8].component_id == 7
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 1)] + [(100, i) for i in range(101, 160)] + [(200 + i, 201 + i) for i in range(30)]
    out = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out[7] == out[3] == 1 and out[5] == 4 and out[159] == 100 and out[230] == 200 and 9 not in out


# --- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(60))
def test_induced_sorting(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 1 + int(rng.choice([1, 2, 3, 20])), int(rng.integers(1, 300))).astype(np.uint8)
    if seed % 2:
        t = np.concatenate([t, t[: len(t) // 2], t[len(t) // 3 :]])
    cap = int(rng.choice([2, 3, 8, 20]))
    s = bytes(t) + b"\0"
    n = collections.Counter(s[i : i + cap] for i in range(len(s) - cap + 1))
    want = [i + cap <= len(s) and n[s[i : i + cap]] > 1 for i in range(len(t))]
    assert induced.repeated(t, cap, induced.Spill(int(rng.choice([0, 300, 10**9])))).tolist() == want  # 0: every block and array is in a file


@pytest.mark.parametrize("batch,least", [(3, 1), (50, 5), (1 << 17, 40)])
def test_recursive_order(monkeypatch, batch, least):
    """Order of the suffixes of strings of names, with small blocks and ranges, runs and periods."""
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "RANGE", least)
    monkeypatch.setattr(induced, "RANGES", 7)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        t = rng.integers(1, 1 + int(rng.choice([1, 2, 3, 20, 500])), int(rng.integers(1, 300)))
        t = np.concatenate([t, t[: len(t) // 2], np.full(seed, 3), np.tile(t[:5], seed % 9)])
        names = np.unique(np.concatenate([t, [0]]), return_inverse=True)[1].astype(np.int32)
        spill = induced.Spill([0, 500, 10**9][seed % 3])
        order = induced._sorted_names(names, int(names.max()) + 1, spill, np.int32)
        assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
        n = collections.Counter(tuple(names[i : i + 6]) for i in range(len(names) - 5))
        want = [i + 6 <= len(names) and n[tuple(names[i : i + 6])] > 1 for i in range(len(names))]
        assert induced.repeated_names(names, int(names.max()) + 1, 6, induced.Spill(10**9)).tolist() == want


def test_shards_beyond_the_budget(spark):
    """Shards of the query's runs are sorted in files beyond the budget."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    runs = suffix_dedup.find_runs(docs).withColumn("n", F.lit(1)).withColumn("contents", F.lit(1))
    rows = suffix_dedup._with_bytes(runs, docs)
    for unit in (0, 1):
        for budget, least in ((2 << 20, 1 << 20), (1 << 18, 5 << 20)):
            out = suffix_dedup.sort_shards(rows.where(F.pmod("key", F.lit(2)) == unit).coalesce(1), budget=budget)
            assert out.agg(F.max("spilled")).first()[0] > least


def test_word_hashes():
    rng = np.random.default_rng(0)
    words = [b"a", b"bc", "ü".encode(), b"x" * 70_000, b"bc"]
    texts = [b"".join(words[int(i)] + [b" ", b"\t\n", b"\r", b" \x0b"][int(i) % 4] for i in rng.integers(0, 5, n)) for n in (0, 1, 40, 7, 0)] + [b"bc", b" ", b"a bc"]
    seen = {}
    for raw, got_hashes in zip(texts, suffix_dedup.word_hashes(texts)):
        assert len(raw.split()) == len(got_hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(raw.split(), got_hashes.tolist()))
    assert len(set(seen.values())) == len(seen) == 4


def plain_removed(docs, length):
    n = collections.Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for key, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((key, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def plain_passages(docs, length=51):
    words = [(key, (text or "").encode().split()) for key, text in docs]
    n = collections.Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = set()
    for key, w in words:
        held = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                held[i : i + length] = True
        out.add((key, int((held & ~np.concatenate([[False], held[:-1]])).sum()), int(held.sum())))
    return out


def removed(df, **kw):
    out = suffix_dedup.deduplicate(df, **kw)
    passages = {tuple(r) for r in out.select("doc_id", "n_passages", "passage_words").collect()}
    assert passages == plain_passages([tuple(r) for r in df.select("doc_id", "text").collect()])
    return sorted([tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()], key=repr)


def test_dedup_query(spark, documents):
    out = sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got(spark, "op4_suffix_dedup")], key=repr)
    assert out == plain_removed([(i, (t or "").encode()) for i, t in documents], 400)
    assert {(r["doc_id"], r["n_passages"], r["passage_words"]) for r in got(spark, "op4_suffix_dedup")} == plain_passages(documents)


@pytest.mark.parametrize("hot", [1, 512])
def test_dedup_small(spark, hot):
    """Short strings, tiny shards, and (hot = 1) the path of anchors with many runs."""
    rng = np.random.default_rng(hot)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared = [word(700), word(450), word(410)]
    docs = [(i, word(int(rng.integers(0, 900))) + (shared[i % 3] if i % 4 else "") + word(int(rng.integers(0, 500)))) for i in range(40)]
    say = lambda n: " ".join(rng.choice(["a", "bc", "d,", "e"], n))
    passages = [say(51), say(60), say(50), say(90)]
    docs += [(50 + i, " ".join([say(int(rng.integers(0, 30))), passages[i % 4], say(int(rng.integers(0, 30)))])) for i in range(16)]
    docs += [(40, shared[0] * 3), (41, None), (42, ""), (43, "x" * 1500), (44, "y " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert removed(df, hot=hot, shard=3000) == plain_removed([(i, (t or "").encode()) for i, t in docs], 400)


def test_dedup_edges(spark, odd):
    """Repeated and null ids are documents of their own."""
    want = plain_removed([(r.doc_id, (r.text or "").encode()) for r in odd.collect()], 400)
    assert removed(odd) == want
    assert removed(odd.where("false")) == []


# --- 5 -----------------------------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(a, b, kind) for a, _, kind, b in sorted(out)]


def test_pii_base_spans():
    rng = np.random.default_rng(2)
    parts = ["a@b.c", "x.y%z@h-1.example.com", "@", "a@b", "@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (456) 555-2186", "+12", "+1 2 3 4 5 6 7 8 9", " ", "x", "-", ".", "é🎉", "00000000000000000000", "12"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 8)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    for text in ("1" * 400_000, "1." * 200_000, "+1(" * 100_000, "a" * 300_000 + "@", "a@" * 100_000, "key=" * 100_000, "(12) " * 80_000):
        pii.all_spans(text, np.zeros(78), {})
    for page in ("<a " * 100_000, "<" * 300_000, "<p>" * 30_000, "<div>x" * 30_000, "<div>" * 30_000 + "</p>x" * 30_000, '<a href="' * 3_000, "&amp;" * 100_000, "<!--" * 50_000):
        html_text.vectors(html_text.blocks(page))
    for text in ("x" * 2_000_000, "a b " * 400_000):
        simhash.fingerprint(text), quality.counts(text), language_id.windows(text.encode()), decontaminate.hashes(text.split())
    assert time.time() - start < 60
    assert not language_id.has_letter("12 ² ½ _") and language_id.has_letter("½ é")


def test_pii_query(spark, documents):
    out = {r["doc_id"]: r for r in got(spark, "op5_pii")}
    texts = dict(documents)
    for i, r in out.items():
        spans = plain_spans(texts[i])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert all(f"{k}:{a}:{b}" in r["spans"].split(",") for a, b, k in spans)
        assert r["n_email"] == sum(k == "email" for _, _, k in spans)
    found = sum("secret" in r["spans"] for r in out.values())
    assert found == sum(bool(re.search(r"password=|token = ", t)) for t in texts.values())


def test_pii_texts_without_digits(spark):
    """Spelled-out addresses and passwords count and are masked in texts without a digit, @ or =."""
    bare = ["write to jane.doe [at] example [dot] org today", "or to jane.doe(at)example.org", "the password: abcdefghij is old"]
    weights = np.zeros(78)
    weights[-1] = 1  # accepts every candidate
    assert [[s[2] for s in pii.all_spans(t, weights, {})[1]] for t in bare] == [["address"], ["address"], ["secret"]]
    df = spark.createDataFrame(list(enumerate(bare)), "doc_id long, text string")
    assert sum(r.n for r in pii.vote_counts(df).collect()) == 3
    assert [r.text for r in pii.mask(df, {"weights": weights}).orderBy("doc_id").collect()] == ["write to <address> today", "or to <address>", "the password: <secret> is old"]


def test_pii_long_secrets():
    """Keys and values of any length, in linear time."""
    import time

    weights = np.zeros(78)
    weights[-1] = 1
    for key, value in (("token", "aB3" * 107), ("AWS_PRODUCTION_SECRET_ACCESS_KEY", "wJalrXUtnFEMI/K7MDENG"), ("k" * 300, "x9" * 5000)):
        assert pii.all_spans(f"{key}={value} end", weights, {})[1][-1] == (len(key) + 1, len(key) + 1 + len(value), "secret")
    start = time.time()
    for text in ("a" * 400_000 + "=", "a_" * 200_000, "key=" + "b" * 400_000, "a b=" * 100_000):
        pii.all_spans(text, weights, {})
    assert time.time() - start < 20


def test_pii_votes_count_in_full(spark, monkeypatch):
    """The reliabilities do not depend on how many patterns train the classifier."""
    texts = ["token=abcd1234efgh", "secret=aaaaaaaa", "version 12 34 56 and call 415 555 2671", "other: something", "x.y [at] example.org", "apikey=" + "9f" * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    whole = pii.fit(df)
    monkeypatch.setattr(pii, "MAX_PATTERNS", 2)
    part = pii.fit(df)
    assert part["prior"] == whole["prior"] and np.array_equal(part["reliability"], whole["reliability"])


def test_pii_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < r, np.where(truth, 1, -1), np.where(truth, -1, 1)) for r in (0.95, 0.8, 0.7, 0.9, 0.6)], 1)
    post, table, prior = pii.reliabilities(votes, np.ones(4000))
    assert abs(prior - 0.4) < 0.05 and ((post > 0.5) == truth).mean() > 0.95 and table[0, 1, 2] > table[4, 1, 2]


def test_pii_mask_and_edges(spark, odd):
    df = odd.union(spark.createDataFrame([(99, "mail a@b.co and 4111 1111 1111 1111 now", "en", 0.0, 5)], odd.schema))
    out = pii.mask(df, pii.fit(df))
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[99] == "mail <email> and <card> now" and texts[2] is None and texts[0] == ""
    assert pii.find(df.where("false"), pii.fit(df.where("false"))).count() == 0


# --- 6 and 10 -----------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([p == q for _, p, q in held]) > 0.9


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_classifier_edges(spark, odd):
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, None), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.where("false"))).collect()} == {0.5}
    net = language_id.fit(odd)
    out = {r.doc_id: r for r in language_id.predict(odd, net).collect()}
    assert out[2].lang_pred == out[0].lang_pred == out[12].lang_pred == "und" and out[12].score == 0.0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(odd.where("false"))).collect()} == {"und"}


def test_quality_query(spark, documents):
    """The query's scores against a plain vote of the nearest labelled documents, ties to the smaller id."""
    rows = {r["doc_id"]: r for r in got(spark, "op6_quality")}
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    labels = common.table(spark, SF, "labels").select("doc_id", "quality").where(common.bucket("doc_id", 5) != 0)
    m = quality.fit(docs, labels)
    for i, text in documents:
        q = (quality.counts(text)[None] * m["idf"]) @ m["basis"]
        if not np.linalg.norm(q) > 1e-9:
            assert rows[i]["score"] == m["prior"]
            continue
        sims = (q / np.linalg.norm(q)) @ m["vectors"].T
        near = sorted(range(len(sims[0])), key=lambda j: (-round(float(sims[0, j]), 5), j))[: quality.K]
        s = [max(0.0, float(sims[0, j])) ** quality.POWER for j in near]
        want = (sum(v * m["labels"][j] for v, j in zip(s, near)) + 0.2 * m["prior"]) / (sum(s) + 0.2)
        assert abs(rows[i]["score"] - want) < 0.02 and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3)


def test_quality_ties():
    """Of equally near labelled vectors those with the smaller id vote."""
    n = 3 * quality.K
    basis = np.zeros((quality.COLS, quality.DIM), np.float32)
    basis[:, 0] = 1
    vectors = np.zeros((n, quality.DIM), np.float32)
    vectors[:, 0] = 1
    m = {"idf": np.ones(quality.COLS, np.float32), "basis": basis, "vectors": vectors, "labels": np.array([1.0] * quality.K + [0.0] * (n - quality.K)), "prior": 0.5}
    assert quality.votes(np.ones((1, quality.COLS), np.float32), m)[0] > 0.99


def test_language_query(spark, documents):
    """The query against the network's plain forward pass over every window of every text."""
    rows = {r["doc_id"]: r for r in got(spark, "op10_language")}
    learned = common.table(spark, SF, "documents").select("doc_id", "text", "lang").where(common.bucket("doc_id", 4) != 2)
    net = language_id.fit(learned)
    for i, text in documents:
        if not any(map(str.isalpha, text)):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
            continue
        p = net._forward(language_id.windows(text.encode()))[-1].mean(0)
        assert abs(rows[i]["score"] - p.max()) < 1e-3 and (rows[i]["lang_pred"] == net.labels[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)


def test_too_many_languages(spark):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert language_id.fit(df).labels == ["l0", "l1", "l2", "l3"]
    with pytest.raises(ValueError):
        language_id.fit(df, most=3)


def test_empty_tables(spark, odd):
    """Tables without rows give tables without rows."""
    none, labels = odd.where("false"), spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int")
    assert quality.score(none, quality.fit(none, labels)).count() == quality.score(none, quality.fit(odd, labels)).count() == 0
    assert language_id.predict(none, language_id.fit(odd)).count() == language_id.predict(none, language_id.fit(none)).count() == 0
    assert encode_documents(none, queries.vocabulary(queries.WORD_MODEL), decode=True).count() == 0


def test_folded_network_is_the_network():
    net = language_id.ByteConvNet(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(net._forward(x)[-1], language_id.probabilities(x, net.tables()), atol=1e-4)


def test_windows_cover_everything():
    for n in (0, 1, 255, 256, 257, 509, 1000, 5003):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8))
        w = language_id.windows(raw)
        step = language_id.WINDOW - max(language_id.SIZES) + 1
        grams = {bytes(r[i : i + 4]) for r in w for i in range(language_id.WINDOW - 3)}
        assert all(raw[i : i + 4] in grams for i in range(n - 3)) and len(w) <= n // step + 1


# --- 7 -----------------------------------------------------------------------------------------------------------------


def plain_containment(docs, items):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = []
    for i, t in docs:
        words = " ".join(re.findall(r"\w+", (t or "").lower()))
        for k, x in items:
            s = shingles(x)
            if s and (n := sum(f" {g} " in f" {words} " for g in s)) >= 0.8 * len(s) - 1e-9:
                out.append((i, k, n, len(s)))
    return sorted(out)


def test_decontaminate_query(spark, documents):
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").collect()]
    out = sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got(spark, "op7_decontaminate"))
    assert out == plain_containment(documents, items) and out


def test_decontaminate_partial_and_short(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: rng.choice(vocabulary, n).tolist()
    items = [(i, " ".join(say(int(rng.integers(1, 40))))) for i in range(60)] + [(60, ""), (61, None), (62, "w1"), (63, "W1, w2")]
    docs = []
    for i in range(150):
        words = say(int(rng.integers(0, 80)))
        own = (items[i % 60][1]).split()
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(len(own)))] = "edited"
        docs.append((i, " ".join(words + own + say(5))))
    docs += [(200, None), (201, ""), (202, "w1 w2")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_containment(docs, items)
    cut = lambda d: sorted(tuple(r)[:4] for r in d.collect())
    assert cut(decontaminate.pairs(a, b)) == want
    before = common.left()
    for block in (1500, 300):  # several blocks, and about thirty; their tables go but for the last
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        assert cut(decontaminate.pairs(a, b)) == want
    assert len(common.left() - before) == 2
    clash = decontaminate.flag(a.withColumn("__found", F.lit("x")).withColumn("matches", F.lit("y")), b, into="own")
    assert clash.columns == ["doc_id", "text", "__found", "matches", "own"] and {tuple(r) for r in clash.select("__found", "matches").collect()} == {("x", "y")}
    assert decontaminate.pairs(a, b.where("false")).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_html_pages(spark):
    out = {r["page_id"]: r for r in got(spark, "op8_html_text")}
    for r in common.table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r.html, re.S).group(1)
        want = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
        want = " ".join(__import__("html").unescape(want).split())
        assert out[r.page_id]["text"] == want and out[r.page_id]["n_chars"] == len(want)


def test_html_layouts():
    """Held-out pages of the training grammar, with all kinds of boilerplate."""
    net, rng = html_text.fit(), np.random.default_rng(321)
    pages = [html_text._example(rng) for _ in range(150)]
    p = net.predict([x for x, _ in pages])
    assert np.mean(np.concatenate([(a >= 0.5) == (y > 0.5) for a, (_, y) in zip(p, pages)])) > 0.97


def test_html_training():
    """A short training from scratch learns most of the grammar; the stored weights come from a longer one."""
    net, rng = html_text.BiLstm(), np.random.default_rng(9)
    net.train(pages=500, epochs=4)
    pages = [html_text._example(rng) for _ in range(80)]
    assert np.mean(np.concatenate([(a >= 0.5) == (y > 0.5) for a, (_, y) in zip(net.predict([x for x, _ in pages]), pages)])) > 0.9


def test_html_paths_of_any_depth():
    """Marks far up the path, many marks on an element and end tags far below still count."""
    many = " ".join(f"c{chr(97 + i)}" for i in range(26))
    inner = f'<div class="{many}">' * 30
    a, b = (html_text.blocks(f"<{tag}>{inner}<p>same text</p>" + "</div>" * 30 + f"</{tag}><p>after</p>") for tag in ("aside", "article"))
    assert a[0][1][0] != b[0][1][0] and a[0][1][1] == 30 * 27 + 2
    assert a[1][1] == b[1][1] == html_text.blocks("<p>after</p>")[0][1]
    deep = html_text.blocks("<article>" + "<div>" * 3000 + "x</article><p>after</p>")
    assert deep[1][1] == html_text.blocks("<p>after</p>")[0][1]
    words = ["one", "two"] * 300
    long, short = (html_text.vectors(html_text.blocks(f"<p>{' '.join(words[:n])}</p>"))[0] for n in (600, 2))
    at = slice(html_text.TAG_COLS, html_text.TAG_COLS + html_text.WORD_COLS)
    assert np.allclose(long[at], short[at] * 300 / np.sqrt(300))


def test_html_edges(spark):
    page = '<html><body><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp;&#8364;<br>line<p>Two<script>no()</script></article><div id="comments"><p>Nice words here</p></div><!-- x > y --><style>p{}</style></body></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain text only"), (5, "<p>unclosed <a href='x>y'>q</a"), (6, "<" * 50 + ">" * 50)], "page_id long, html string")
    out = {r.page_id: r.text for r in html_text.extract(df.withColumn("text", F.lit("clash"))).collect()}
    assert out[1] == "A & B One bold € line Two" and out[2] == out[3] == ""
    assert html_text.extract(df.where("false")).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_token_files_query(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary(queries.BYTE_MODEL))
    at, want = 0, []
    for (i, _), e in zip(documents, tok.encode_batch([t or "" for _, t in documents], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got(spark, "op9_token_files")) == want


def test_chunked_encoding_equals_library():
    from tokenizers import Tokenizer

    with open(queries.vocabulary(queries.BYTE_MODEL), encoding="utf-8") as f:
        raw = f.read()
    rng, letters = np.random.default_rng(3), list("ab the ing  \n\t▁éß🎉日本 0123.,!er on\x1c\xa0 's")
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(8000)]
    texts += [" ".join(rng.choice(["a", "b\nc", "\nd", "e\n", "ü", "1", "...", "'s", "word,", "word."], 8)) for _ in range(2000)]
    for text, want, ids in zip(texts, Tokenizer.from_str(raw).encode_batch(texts, add_special_tokens=False), token_files.ByteBpe(raw).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("seed", range(20))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 5000))
    ids = rng.integers(0, 2**62, n, dtype=np.uint64) >> rng.integers(0, 62, n).astype(np.uint64) if seed % 3 else rng.integers(0, int(rng.choice([1, 2, 50257])), n).astype(np.uint64)
    if n and seed % 2:
        ids[rng.integers(0, n, 9)] = 2**64 - 1  # escapes
    words, sizes = token_files.pack(ids)
    assert (token_files.unpack(words, n) == ids).all() and sizes.sum() == len(words)


def test_token_files_edges(spark, odd):
    out = [tuple(r) for r in token_files.token_files(odd, queries.vocabulary(queries.BYTE_MODEL)).orderBy("start").collect()]
    assert len(out) == odd.count() and out[0][:2] == (None, 0)
    assert [r[0] for r in out[1:]] == sorted(r[0] for r in out[1:])
    assert all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:]))
    assert token_files.token_files(odd.where("false"), queries.vocabulary(queries.BYTE_MODEL)).count() == 0


def test_words_are_encoded_once_whatever_follows(monkeypatch):
    with open(queries.vocabulary(queries.BYTE_MODEL), encoding="utf-8") as f:
        raw = f.read()
    bpe, asked = token_files.ByteBpe(raw), []
    letters = bpe._letters
    monkeypatch.setattr(bpe, "_letters", lambda text: asked.append(text) or letters(text))
    texts = ["Start zyxword, zyxword. (zyxword zyxword!?", "zyxword; zyxword\nzyxword,\nzyxword.", "étéx, étéx 12, 12", "a ", "\na", "a\n\nb", "a \nb", "a\n b", "a\n", ",", " "]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
    assert got == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == [" zyxword", " étéx", "Start", "zyxword", "zyxword", "étéx"]  # first in a text and after a line break apart
