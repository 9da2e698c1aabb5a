"""Near duplicates by SimHash: tiled exact comparison of fingerprints.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles. Distinct
fingerprints fall into cells by the population counts of their two halves, cells into tiles of bounded size. Two tiles
are compared only if the counts differ by no more than the radius in all; inside, blocks are skipped alike by the
counts of four quarters, and the rest is compared with exclusive-or and bit counts. Nothing is missed or estimated.
A pair of tiles yields a spanning forest of its links, never all pairs of a group.

Null texts count as empty: fingerprint zero. Rows with a null doc_id get a fingerprint but link nothing; their
component is that of their fingerprint, if another row has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import map_texts, stored
from cuelake.llm.components import connected_components

RADIUS, SHINGLE, SEED = 2, 3, 42
TILE, BLOCK = 8192, 256
#: Blocks that a block is compared with at a time; bounds memory whatever a tile's size is.
COMPARED = 32
#: The same where whole groups of near copies meet, and fingerprints that share a key on average, at most.
FEWER, CROWD = 4, 64


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order; of all words if there are no more; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(buf[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Adds `fp`, the fingerprint as a signed long."""
    return map_texts(df, text_col, lambda: lambda texts: {"fp": [signed(fingerprint(t, shingle)) for t in texts]}, [T.StructField("fp", T.LongType())], keep)


def _lanes(x: np.ndarray, n: int) -> np.ndarray:
    """Population counts of n equal lanes, as columns."""
    width = 64 // n
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((x >> np.uint64(width * i)) & mask) for i in range(n)], 1).astype(np.int16)


def _cells(x: np.ndarray, width: int = 1) -> np.ndarray:
    p = _lanes(x, 2).astype(np.int64) // width
    return p[:, 0] * 33 + p[:, 1]


def _near(radius: int, width: int = 1) -> list[tuple[int, int]]:
    """Offsets of the cells, of so many counts a side, that may hold fingerprints within the radius."""
    gap = lambda d: (abs(d) - 1) * width + 1 if d else 0
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if gap(i) + gap(j) <= radius]


def links(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool, radius: int = RADIUS, compared: int = COMPARED) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, in ids, of the links between (or, if same, among) two tiles of fingerprints."""
    x, ids = (a, ids_a) if same else (np.concatenate([a, b]), np.concatenate([ids_a, ids_b]))
    na = len(a)
    label = np.arange(len(x))

    def blocks(start, fp):
        lanes = _lanes(fp, 4)
        order = np.lexsort(lanes.T)
        cuts = [order[i : i + BLOCK] for i in range(0, len(order), BLOCK)]
        return [o + start for o in cuts], np.array([lanes[o].min(0) for o in cuts]).reshape(-1, 4), np.array([lanes[o].max(0) for o in cuts]).reshape(-1, 4)

    left, lo_a, hi_a = blocks(0, a)
    right, lo_b, hi_b = (left, lo_a, hi_a) if same else blocks(na, b)
    for i, rows in enumerate(left):
        gap = np.maximum(np.maximum(lo_a[i] - hi_b, lo_b - hi_a[i]), 0).sum(1)
        near = [j for j in np.flatnonzero(gap <= radius) if not same or j >= i]
        if not near:
            continue
        for part in range(0, len(near), compared):
            cols = np.concatenate([right[j] for j in near[part : part + compared]])
            r, c = np.divmod(np.flatnonzero(np.bitwise_count(x[rows][:, None] ^ x[cols][None, :]) <= radius), len(cols))
            u, v = label[rows[r]], label[cols[c]]
            differ = u != v
            if not differ.any():
                continue
            pairs = np.unique(np.stack([np.minimum(u, v)[differ], np.maximum(u, v)[differ]], 1), axis=0)
            parent: dict[int, int] = {}

            def find(n, parent=parent):
                while (p := parent.get(n, n)) != n:
                    parent[n] = parent.get(p, p)
                    n = p
                return n

            for p, q in pairs.tolist():
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            to = np.arange(len(x))
            for n in parent:
                to[n] = find(n)
            label = to[label]
    moved = np.flatnonzero(label != np.arange(len(x)))
    return ids[moved], ids[label[moved]]


def link_forest(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, width: int = 1, most: int = 0) -> DataFrame:
    """distinct: fp, rep (both long, one row per fingerprint). Edges a, b between reps of linked fingerprints.

    A radius that skips few cells may have cells of more counts a side (width) and larger tiles, so that there are
    about `most` of them: every fingerprint is sent to all tiles near its own.
    """
    halves = [F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp", 32))]
    halves = [F.floor(h / width).cast("int") for h in halves]
    counts = {r.cell: r["count"] for r in distinct.groupBy((halves[0] * 33 + halves[1]).alias("cell")).count().collect()}  # 1089 cells at most
    tile = max(tile, -(-sum(counts.values()) // most)) if most else tile
    subs = np.zeros(33 * 33, np.int64)
    for cell, n in counts.items():
        subs[cell] = -(-n // tile)
    near = _near(radius, width)

    def deal(batches):
        schema = pa.schema([("pair", pa.string()), ("side", pa.int32()), ("fp", pa.int64()), ("rep", pa.int64())])
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            x = fp.view(np.uint64)
            cell = _cells(x, width)
            sub = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % np.maximum(subs[cell], 1)
            for di, dj in near:
                i, j = cell // 33 + di, cell % 33 + dj
                ok = (i >= 0) & (i <= 32) & (j >= 0) & (j <= 32)
                other = np.where(ok, i * 33 + j, 0)
                ok &= subs[other] > 0
                for s in range(int(subs[other[ok]].max()) if ok.any() else 0):
                    m = np.flatnonzero(ok & (subs[other] > s))
                    mine, its = cell[m] * 10_000_000 + sub[m], other[m] * 10_000_000 + s
                    lo, hi = np.minimum(mine, its), np.maximum(mine, its)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{p}-{q}" for p, q in zip(lo.tolist(), hi.tolist())]), pa.array((mine > its).astype(np.int32)), pa.array(fp[m]), pa.array(rep[m])], schema=schema)

    def compare(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def done():
            side, fp, rep = (np.concatenate([h[i] for h in held]) for i in range(3))
            same = len(set(key.split("-"))) == 1
            x = fp.view(np.uint64)
            m = side == 0
            u, v = links(x[m], x[~m], rep[m], rep[~m], same, radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    if held:
                        yield done()
                    key, held = keys[a], []
                held.append([c[a:b] for c in cols])
        if held:
            yield done()

    dealt = distinct.select("fp", "rep").mapInArrow(deal, "pair string, side int, fp long, rep long")
    return dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")


def key_bits(n: int) -> int:
    """Bits of a key, so that about CROWD of n fingerprints share one."""
    return max(0, (-(-n // CROWD) - 1).bit_length())


def key_links(distinct: DataFrame, radius: int, keys: int) -> DataFrame:
    """distinct: fp, rep (both long, one row per fingerprint). Edges a, b between reps of fingerprints within the radius.

    For wide radii, at which link_forest can skip nothing: only fingerprints that agree in all bits of a key are compared.
    A key's bits grow with the logarithm of the table, so that rows and comparisons grow with the table; a pair that
    differs in d bits shares none of the keys of b bits with a probability of about (1 - (1 - b / 64) ** d) ** keys.
    """
    bits = key_bits(distinct.count())
    rng = np.random.default_rng(SEED)
    masks = [sum(1 << int(i) for i in rng.permutation(64)[:bits]) for _ in range(keys if bits else 1)]

    def compare(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def done():
            x, ids = np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held])
            if len(x) <= BLOCK and np.count_nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius) == len(x):
                return []  # as most keys
            return [links(x, x[:0], ids, ids[:0], True, radius, FEWER)]

        def batch_of(found):
            u, v = (np.concatenate([f[i] for f in found]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

        for batch in batches:
            mask, part, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(fp)]
            found = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (mask[a], part[a]) != key:
                    if held:
                        found += done()
                    key, held = (mask[a], part[a]), []
                held.append((fp[a:b].copy(), rep[a:b].copy()))
            if found:
                yield batch_of(found)
        if held and (found := done()):
            yield batch_of(found)

    own = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)]))
    dealt = distinct.select(own.alias("key"), "fp", "rep").select("key.mask", "key.part", "fp", "rep")
    return dealt.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """df: doc_id (integer) and a text. Returns doc_id, fp and component_id for every row."""
    docs = stored(fingerprints(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", shingle, ["doc_id"]), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(link_forest(distinct.where("rep is not null"), radius))
    by_fp = distinct.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")
