"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Texts become counts of hashed words, hashed word shapes and a few repetition measures, weighted by inverse document
frequency; a singular-value decomposition of the labelled sample's rows gives the latent space. The labelled vectors
are broadcast (at most SAMPLE rows of DIM numbers, a documented bound of the fit). For every document the cosines with
all of them are computed in blocks; its K nearest vote, weighted by a power of their similarity.

Null and empty texts score like the labelled empty texts' prior: the share of good labels. Labels, language, source
and id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import map_texts, remembers

WORD_COLS, SHAPE_COLS, EXTRA_COLS = 768, 512, 24
COLS = WORD_COLS + SHAPE_COLS + EXTRA_COLS
SAMPLE, DIM, K, POWER = 4000, 48, 25, 6
THRESHOLD = 0.3
CACHE_WORDS = 300_000

_WORDS: dict[str, int] = {}
remembers(__name__, _WORDS.clear)


def _code(word: str) -> int:
    """Column of the word in the low half, of its shape in the high one."""
    shape = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", re.sub(r"\d", "9", word))
    shape = re.sub(r"(\w)\1+", r"\1", shape)[:10]
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_COLS | (zlib.crc32(shape.encode("utf-8", "replace")) % SHAPE_COLS) << 16


def counts(text: str | None) -> np.ndarray:
    """The document's row before weighting."""
    out = np.zeros(COLS, np.float32)
    words = (text or "").split()
    if not words:
        return out
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    for w in [w for w in set(words) if w not in _WORDS]:
        _WORDS[w] = _code(w)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.int32, len(words))
    n = len(words)
    out[:WORD_COLS] = np.log1p(np.bincount(codes & 65535, minlength=WORD_COLS))
    out[WORD_COLS : WORD_COLS + SHAPE_COLS] = 4 * np.sqrt(np.bincount(codes >> 16, minlength=SHAPE_COLS) / n)
    same = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    far = [float((codes[k:] == codes[:-k]).mean()) if n > k else 0.0 for k in (7, 23)]
    distinct = len(np.unique(codes)) / n
    lines = text.split("\n")
    again = 1 - len(set(lines)) / len(lines)
    mean = len(text) / n
    for i, (x, edges) in enumerate(((same, (0.02, 0.1, 0.3)), (max(far), (0.1, 0.3, 0.6)), (distinct, (0.1, 0.3, 0.6)), (again, (0.1, 0.3, 0.6)), (np.log2(n), (4, 7, 10)), (mean, (4.5, 6, 9)))):
        out[WORD_COLS + SHAPE_COLS + 4 * i + int(np.searchsorted(edges, x))] = 2.0
    return out


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """documents: doc_id, text. labels: doc_id, quality (0 or 1; nulls are left out; several per id: the largest)."""
    spark = documents.sparkSession
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = [tuple(r) for r in chosen.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).limit(sample).collect()]
    if not ids:
        return None
    small = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int"))  # `sample` rows at most
    joined = documents.select("doc_id", "text").join(small, "doc_id")
    rows = map_texts(joined, "text", lambda: lambda texts: {"row": [counts(t).tobytes() for t in texts]}, [T.StructField("row", T.BinaryType())], ["doc_id", "quality"]).limit(2 * sample).collect()
    rows.sort(key=lambda r: (r.doc_id, r.row))
    if not rows:
        return None
    x = np.array([np.frombuffer(r.row, np.float32) for r in rows], np.float32)
    y = np.array([r.quality for r in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.2
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, ::-1][:, :DIM].astype(np.float32)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return {"idf": idf, "basis": basis, "vectors": z, "labels": y, "prior": float(y.mean())}


def votes(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of unweighted rows."""
    q = (x * model["idf"]) @ model["basis"]
    norm = np.linalg.norm(q, axis=1)
    q /= np.maximum(norm, 1e-9)[:, None]
    sims = q @ model["vectors"].T
    k = min(K, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, near, 1).min(1, keepdims=True)
    for i in np.flatnonzero((sims == least).sum(1) > (np.take_along_axis(sims, near, 1) == least).sum(1)):  # ties across the cut
        near[i] = np.argsort(-sims[i], kind="stable")[:k]
    s = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** POWER
    out = ((s * model["labels"][near]).sum(1) + 0.2 * model["prior"]) / (s.sum(1) + 0.2)
    return np.where(norm > 1e-9, np.clip(out, 0, 1), model["prior"])


def score(df: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `score`; without any label everything scores 0.5."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE, DIM and COLS

    def task():
        m = shared.value

        def apply(texts):
            if m is None:
                return {"score": [0.5] * len(texts)}
            out = [votes(np.array([counts(t) for t in texts[i : i + 256]]), m) for i in range(0, len(texts), 256)]
            return {"score": np.concatenate(out).tolist() if out else []}

        return apply

    return map_texts(df, text_col, task, [T.StructField("score", T.DoubleType())], keep)
