"""Benchmark items inside long documents: size-partitioned MinHash containment, verified exactly.

Items fall into partitions by their number of distinct five-word shingles. An item's signature is its smallest
shingle hashes, as many as its partition's largest item may lose plus one; so a document that contains the wanted
share of an item holds one of them for certain (pigeonhole): no match is missed. Documents of any length are probed
shingle by shingle; whatever hits a signature is verified by exact shingle containment.

Words are runs of word characters, lower-cased; fewer than five words make one shingle of all; items without a word
match nothing, nor do null texts. Items are sent to the executors in blocks of at most BLOCK_CHARS characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import drop, free_name, map_texts, remembers, stored

SHINGLE, SHARE = 5, 0.8
BLOCK_CHARS = 16_000_000
CACHE_WORDS = 300_000
WORD = re.compile(r"\w+")
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1) for i in range(SHINGLE)]

_HASHES: dict[str, int] = {}
remembers(__name__, _HASHES.clear)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash per shingle position."""
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    for w in [w for w in set(words) if w not in _HASHES]:
        _HASHES[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * MIX[j]
    return (out ^ (out >> np.uint64(29))) * MIX[-1]


class Signatures:
    """The probe structure of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE):
        self.items, pairs = [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            distinct, n = np.unique(hashes(words)), len(shingles(words))
            size_class = n.bit_length()  # partition: sizes of as many binary digits
            largest = (1 << size_class) - 1
            m = min(len(distinct), int((1 - share) * largest + 1e-9) + 1)
            index = len(self.items)
            self.items.append((item_id, sorted(shingles(words)), len(words) < SHINGLE))
            pairs += [(int(h), index) for h in distinct[:m]]
        pairs.sort()
        self.keys = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([i for _, i in pairs], np.int64)
        self.coarse = np.zeros(65536, bool)
        self.coarse[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.short = {len(s[0].split(" ")) for _, s, short in self.items if short}
        self.share = share

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles of the item) for items of which the text holds the wanted share."""
        words = words_of(text)
        if not words or not len(self.keys):
            return []
        g = hashes(words)
        for k in self.short:  # items of fewer than five words are one shorter shingle
            if len(words) >= SHINGLE > k or len(words) > k:
                h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
                s = np.zeros(len(words) - k + 1, np.uint64)
                for j in range(k):
                    s += h[j : j + len(s)] * MIX[j]
                g = np.concatenate([g, (s ^ (s >> np.uint64(29))) * MIX[-1]])
        g = g[self.coarse[(g >> np.uint64(48)).astype(np.int64)]]
        if not len(g):
            return []
        g = np.unique(g)
        a, b = np.searchsorted(self.keys, g, "left"), np.searchsorted(self.keys, g, "right")
        found = sorted({int(i) for x, y in zip(a, b) if y > x for i in self.owner[x:y]})
        if not found:
            return []
        whole, out = f" {' '.join(words)} ", []
        for i in found:
            item_id, own, _ = self.items[i]
            shared = sum(f" {s} " in whole for s in own)
            if shared >= self.share * len(own) - 1e-9:
                out.append((item_id, shared, len(own)))
        return out


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_shingles", T.LongType())]))


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    place = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n))
    return [benchmark.where(place == b) if n > 1 else benchmark for b in range(n)]


def flag(df: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = SHARE, keep: list[str] | None = None, into: str = "matches") -> DataFrame:
    """Adds a column `into`, an array of (item_id, n_shared, n_shingles); one of that name is replaced.

    A block of items at a time is broadcast. With several, the rows found so far are written between two blocks, so that
    driver and executors never hold more than one.
    """
    spark = df.sparkSession
    columns = [c for c in (df.columns if keep is None else keep) if c != into]
    sent = list(dict.fromkeys([*columns, text_col]))
    out, now, blocks, sofar = df.select(*sent), free_name(sent, "__found"), _blocks(benchmark.select(F.col("item_id").cast("long"), "text")), None
    for i, block in enumerate(blocks):
        items = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect() if r.item_id is not None])  # BLOCK_CHARS at most

        def task(items=items):
            probe = Signatures(items.value, share)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())]))
            return lambda texts: {now: pa.array([[{"item_id": x, "n_shared": y, "n_shingles": z} for x, y, z in probe.matches(t)] for t in texts], kind)}

        found = map_texts(out, text_col, task, [T.StructField(now, MATCHES)], out.columns)
        whole = F.col(now) if i == 0 else F.array_sort(F.concat(into_, now))
        into_ = free_name(sent, into)
        out = found.select(*sent, whole.alias(into_))
        if len(blocks) > 1:
            out = stored(out, "matches")
            items.unpersist()
            if sofar is not None:
                drop(sofar)
            sofar = out
    return out.select(*columns, F.col(into_).alias(into))


def pairs(df: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: one row per document and item found in it."""
    found = flag(df, benchmark, share=share, keep=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", "m.n_shared", "m.n_shingles", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment")
    )
