"""Vector arithmetic and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.ranking import top_k

#: Queries that are compared at a time; a block is sent to every task.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d))


def blend(query: Column, other: Column, alpha: float) -> Column:
    """(1 - alpha) * query + alpha * other, scaled to length one unless it is zero."""
    mixed = F.zip_with(query, other, lambda q, h: q.cast("double") * (1 - alpha) + h.cast("double") * alpha)
    n = norm(mixed)
    return F.when(n > 0, F.transform(mixed, lambda x: x / n)).otherwise(mixed)


def _nearest(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite values of each row, ties to the smaller id."""
    n = s.shape[1]
    if n <= k:
        return np.nonzero(np.isfinite(s))
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(s, near, 1)
    least = values.min(1, keepdims=True)
    for i in np.flatnonzero((s == least).sum(1) > (values == least).sum(1)):  # ties across the cut
        near[i] = np.lexsort((ids, -s[i]))[:k]
    row, place = np.nonzero(np.isfinite(np.take_along_axis(s, near, 1)))
    return row, near[row, place]


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """queries: query_id, embedding; base: doc_id, embedding. query_id, doc_id, score, rank.

    The stated queries meet the base in blocks: every task multiplies its part of the base by a block of queries and
    passes on its k best, so that the shuffle carries k rows a query and task. Metrics: cosine, dot, euclid (negated).
    A vector is compared with those of its own length; null vectors take no part.
    """
    spark = queries.sparkSession
    kinds = {n: "string" if dict(d.dtypes)[n] == "string" else "long" for d, n in ((queries, "query_id"), (base, "doc_id"))}
    arrow = {n: pa.string() if kind == "string" else pa.int64() for n, kind in kinds.items()}
    schema = pa.schema([("query_id", arrow["query_id"]), ("doc_id", arrow["doc_id"]), ("score", pa.float64())])
    ddl = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    asked = queries.where("embedding is not null")
    sizes = {r.d: r["count"] for r in asked.groupBy(F.size("embedding").alias("d")).count().collect()}
    out = spark.createDataFrame([], ddl)
    for d, n in sorted(sizes.items()):
        parts = -(-n // BLOCK)
        alike = base.where("embedding is not null").where(F.size("embedding") == d).select(F.col("doc_id").cast(kinds["doc_id"]), "embedding")
        for i in range(parts):
            block = asked.where(F.size("embedding") == d).where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            rows = block.select(F.col("query_id").cast(kinds["query_id"]), "embedding").collect()  # about BLOCK
            held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], np.float64).reshape(len(rows), d)))

            def task(batches, held=held, d=d):
                ids, q = held.value
                qn = np.linalg.norm(q, axis=1)
                for batch in batches:
                    if not batch.num_rows or not len(ids):
                        continue
                    docs = np.array(batch.column(0).to_pylist())
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    s = q @ x.T
                    if metric == "cosine":
                        s /= np.maximum(qn[:, None] * np.linalg.norm(x, axis=1), 1e-300)
                    elif metric == "euclid":
                        s = -np.sqrt(np.maximum(qn[:, None] ** 2 + (x * x).sum(1) - 2 * s, 0))
                    s = np.round(s, 6)
                    if skip_self:
                        s[ids[:, None] == docs[None]] = -np.inf
                    row, near = _nearest(s, docs, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row].tolist(), arrow["query_id"]), pa.array(docs[near].tolist(), arrow["doc_id"]), pa.array(s[row, near])], schema=schema)

            out = out.union(alike.mapInArrow(task, ddl))
    return top_k(out, k)


def related(base: DataFrame, source_id: int, k: int, same_video: bool = False) -> DataFrame:
    """base: doc_id, embedding, video_id. The nearest of one document, without itself, if wanted of its video only."""
    source = base.where(F.col("doc_id") == source_id)
    pool = base.join(source.select("video_id").limit(1), "video_id", "left_semi") if same_video else base
    return knn(source.select(F.col("doc_id").alias("query_id"), "embedding"), pool, k, skip_self=True)
