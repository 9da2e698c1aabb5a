"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to CURVES groups of DIMS orthogonal directions, shifted and put on a Hilbert curve each. The
curves' keys are cut into ranges (borders from a bounded sample of SAMPLE vectors, a documented bound of the fit); every
vector is dealt to its range of each curve, every query to that range and its neighbours. Each range ranks its
candidates by the inner product in double precision on the original vectors; the ranges' best merge per query.

WINDOW of RANGES ranges are searched on each curve at every size of the table: vectors without structure have no shorter
list that holds nine tenths of the neighbours (README has the measured figures). Only a table with so few vectors that
a range could not hold a list of k + 1 has fewer ranges. Candidates and queries of a range are compared by tiles, so
that no task grows with the table.

Equal vectors are searched once: each distinct vector keeps the smallest k + 1 of its ids, which is all that a list of
k can show. Null, zero and non-finite vectors, and those of another length than the commonest, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cuelake.llm.common import stored

CURVES, DIMS, BITS = 16, 8, 6
RANGES, WINDOW, SAMPLE = 25, 3, 20_000
#: Candidates and queries of a range that one task compares at most, about.
TILE, ASKED = 16_384, 4096
K = 20


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of rows of cell numbers (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(n):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(inverted, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Projections, shifts and range borders, fitted on a sample."""

    def __init__(self, sample: np.ndarray, ranges: int, seed: int = 17):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        dims, groups = min(DIMS, d), []
        while len(groups) < CURVES:  # groups of one rotation are orthogonal to each other
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
            groups += [turn[:, i : i + dims] for i in range(0, d - dims + 1, dims)]
        self.axes, self.shift = groups[:CURVES], rng.uniform(0, 0.5, (CURVES, dims))
        self.low, self.span = [], []
        for a in self.axes:
            y = sample @ a
            lo, hi = np.quantile(y, 0.005, axis=0), np.quantile(y, 0.995, axis=0)
            self.low.append(lo)
            self.span.append(np.maximum(hi - lo, 1e-12))
        self.borders = [np.quantile(self.keys(sample, c), np.arange(1, ranges) / ranges) for c in range(CURVES)]
        self.ranges = ranges

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        y = ((x @ self.axes[c] - self.low[c]) / self.span[c] + self.shift[c]) / 1.5
        return hilbert_keys(np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64))

    def range_of(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.borders[c], self.keys(x, c), "right")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: embedding, ids (its k + 1 smallest, ascending). Hot vectors shrink in steps."""
    for salt in (64, 8):
        place = F.pmod(F.xxhash64("vec_id"), F.lit(salt))
        rows = rows.withColumn("__r", F.row_number().over(W.partitionBy("embedding", place).orderBy("vec_id"))).where(F.col("__r") <= k + 1).drop("__r")
    return rows.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def search(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """rows: vec_id, embedding. is_query: a condition on vec_id. Returns query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    e = F.col("embedding")
    whole = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & whole)
    sizes = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    d = sizes[0].d
    valid = valid.where(F.size("embedding") == d).distinct()
    vectors = stored(_distinct(valid, k).select(F.col("ids")[0].alias("rep"), "ids", "embedding"), "vectors")
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    curves = Curves(_matrix(sample.combine_chunks() if hasattr(sample, "combine_chunks") else sample, d), max(1, min(RANGES, n // (k + 1))))
    tiles = -(-n // curves.ranges // TILE) or 1
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("query", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    window = min(WINDOW, curves.ranges)

    def deal(as_query, parts):
        """parts: tiles that the queries of a range make; every candidate goes to each."""

        def task(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, reps = _matrix(batch.column(1), d), batch.column(0).to_numpy(zero_copy_only=False)
                for c in range(CURVES):
                    own = curves.range_of(x, c)
                    if as_query:  # the window stays inside the curve
                        first = np.clip(own - window // 2, 0, curves.ranges - window)
                        cells = [((first + w) * tiles + t) * parts + reps // tiles % parts for w in range(window) for t in range(tiles)]
                    else:
                        cells = [(own * tiles + reps % tiles) * parts + u for u in range(parts)]
                    for cell in cells:
                        yield pa.RecordBatch.from_arrays([pa.array(cell + c * curves.ranges * tiles * parts, pa.int64()), pa.array(np.full(len(reps), as_query)), batch.column(0), batch.column(1)], ["cell", "query", "rep", "embedding"])

        return task

    def rank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        kind = [("q", pa.int64()), ("found", pa.list_(pa.struct([("down", pa.float64()), ("rep", pa.int64())])))]
        reps, x = table["rep"].to_numpy(), _matrix(table["embedding"].combine_chunks() if hasattr(table["embedding"], "combine_chunks") else table["embedding"], d)
        base, b_ids, q, q_ids = x[~query], reps[~query], x[query], reps[query]
        if not len(base) or not len(q):
            return pa.Table.from_pydict({"q": [], "found": []}, pa.schema(kind))
        m = min(k + 1, len(base))
        down, near_ids = np.empty((len(q), m)), np.empty((len(q), m), np.int64)
        for i in range(0, len(q), 512):
            s = q[i : i + 512] @ base.T
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            down[i : i + 512] = -(q[i : i + 512][:, None, :] * base[near]).sum(2)
            near_ids[i : i + 512] = b_ids[near]
        pairs = pa.StructArray.from_arrays([pa.array(down.ravel()), pa.array(near_ids.ravel())], names=["down", "rep"])
        found = pa.ListArray.from_arrays(pa.array(np.arange(0, len(q) * m + 1, m), pa.int32()), pairs)
        return pa.Table.from_arrays([pa.array(q_ids), found], schema=pa.schema(kind))

    # The queries' distinct vectors; a hot vector's rows stay apart in this join.
    queries = stored(valid.where(is_query).join(vectors.select("rep", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")), "queries")
    asked = vectors.join(queries.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
    parts = -(-asked.count() * window // curves.ranges // ASKED) or 1
    dealt = vectors.select("rep", "embedding").mapInArrow(deal(False, parts), schema).union(asked.select("rep", "embedding").mapInArrow(deal(True, parts), schema))
    ranked = dealt.groupBy("cell").applyInArrow(rank, "q long, found array<struct<down: double, rep: long>>")
    # At most CURVES * WINDOW * tiles lists of k + 1 per query.
    best = ranked.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))
    listed = best.select("q", F.explode("found").alias("f")).select("q", (-F.col("f.down")).alias("score"), F.col("f.rep").alias("rep"))
    shown = listed.join(vectors.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    shown = shown.withColumn("__r", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("__r") <= k + 1).drop("__r")
    out = queries.join(stored(shown, "lists"), "q").where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
