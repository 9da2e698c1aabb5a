"""Removal of every byte covered by a repeated string of LENGTH bytes, exactly, by sharded suffix sorting.

Each window of LENGTH bytes has an anchor: the leftmost smallest hash of its ANCHOR-byte strings. Equal windows have
equal anchors, so the runs of windows that share an anchor can be dealt out by its hash: all copies of a window meet in
one shard, and anchors that occur once are done. Equal runs are counted and kept once. The different runs of an anchor
are joined, with separators, to shards of about SHARD bytes, whose suffixes are sorted with their common prefixes by
external induced sorting (module induced); a window is repeated if it shares LENGTH bytes with a neighbour in the order.
What a shard's sort holds beyond BUDGET is in files, so that a shard may be far larger than memory.
An anchor with more than HOT different runs is dealt out further, so that no task grows with it: pieces of its runs,
down to single windows, are counted by 128-bit digests.

Passages of more than 50 words that start anywhere else too are found alike, with words in place of bytes (PASSAGE words
a window, strings of GRAM words as anchors); they are counted, not removed. They may be shorter than LENGTH bytes.

Matches are never across documents, and judged on the input. Null texts count as empty. Repeated rows are documents of
their own. A null doc_id is kept as it is.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import drop, slices, stored
from cuelake.llm.induced import Spill, repeated, repeated_names

LENGTH, ANCHOR = 400, 128
PASSAGE, GRAM = 51, 16
SHARD, HOT = 4_000_000, 512
#: Bytes of queues and arrays that a shard's sort keeps in memory.
BUDGET = 24 << 20
#: Units that are anchored at a time: of a document, and of short ones together.
CHUNK, GROUP = 1 << 18, 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACES = re.compile(rb"[ \t-\r]")
IN_WORD = np.array([SPACES.match(bytes([c])) is None for c in range(256)])


class Unit(NamedTuple):
    """What windows are made of. The lowest bit of a key tells the unit: 0 for bytes, 1 for words (by their hashes)."""

    mark: int
    kind: type
    length: int
    anchor: int

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & ~np.uint64(1) | np.uint64(self.mark)).view(np.int64)


def units(length: int = LENGTH) -> tuple[Unit, Unit]:
    return Unit(0, np.uint8, length, ANCHOR), Unit(1, np.uint64, PASSAGE, GRAM)


def _pieces(raw: bytes) -> list[tuple[int, int]]:
    """Parts of about GROUP bytes that end with a white space, or with the text."""
    out, at = [], 0
    while at < len(raw):
        found = SPACES.search(raw, at + GROUP)
        end = found.end() if found else len(raw)
        out.append((at, end))
        at = end
    return out


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash per word of each text, a polynomial of its bytes; words are parted by ASCII white space."""
    joined = b"\n".join(raws)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    powers = inverses = np.ones(1, np.uint64)
    for at, end in _pieces(joined):
        x = np.frombuffer(joined, np.uint8, end - at, at)
        if len(x) >= len(powers):
            powers, inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(x), f))]) for f in (BASE, np.uint64(pow(int(BASE), -1, 2**64))))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], IN_WORD[x], [False]])))
        a, b = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)])])
        h = (sums[b] - sums[a]) * inverses[a]
        starts.append(a + at)
        hashes.append((h ^ (h >> np.uint64(31))) * BASE)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends[:-1])) if raws else []


def _slices(batch: pa.RecordBatch):
    """Parts of a batch; what they took goes back to the system, as later stages of the worker need it."""
    yield from slices(batch, "text")
    pa.default_memory_pool().release_unused()


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of a width."""
    have, w = x, 1
    while w < width:
        step = min(w, width - w)
        have = np.minimum(have[:-step], have[step:])
        w += step
    return have


def _hashes(x: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of a width, a power of two."""
    h, w, power = x.astype(np.uint64) + np.uint64(1), 1, np.full(1, BASE)
    while w < width:  # polynomials of 2, 4, 8 ... bytes
        h = h[:-w] * power + h[w:]
        power, w = power * power, 2 * w
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _groups(texts: list[np.ndarray]) -> list[list[int]]:
    """Neighbouring texts of about GROUP units in all, or a longer one alone."""
    out, size = [], GROUP
    for i, x in enumerate(texts):
        if not out or size + len(x) > GROUP:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(x)
    return out


def runs(texts: list[np.ndarray], unit: Unit):
    """(text, start, end, key) of the runs of windows that share an anchor, and their joined units by start and end there; end: where the last window ends."""
    for group in _groups(texts):
        x = np.concatenate([texts[i] for i in group])
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes)
        for at in range(0, max(len(x) - unit.length + 1, 0), CHUNK):
            y = x[at : at + CHUNK + unit.length - 1]
            h = _hashes(y, unit.anchor)
            low = _slide((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), unit.length - unit.anchor + 1)
            owner = np.searchsorted(ends, np.arange(at, at + len(low)), "right")
            inside = np.flatnonzero(np.arange(at, at + len(low)) + unit.length <= ends[owner])  # windows within one text
            if not len(inside):
                continue
            place, owner = (low[inside] & np.uint64(0xFFFFFF)).astype(np.int64), owner[inside]
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
            last = np.concatenate([first[1:], [len(place)]]) - 1
            a, b, owner = inside[first], inside[last] + unit.length, owner[first]
            base = (ends - sizes)[owner] - at
            yield np.array(group)[owner], a - base, b - base, unit.key(h[place[first]]), y, a, b


def _binary(values: np.ndarray) -> pa.Array:
    """An array of eight-byte strings."""
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, 8 * len(values) + 1, 8, dtype=np.int32)), pa.py_buffer(values)])


def _contents(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Digests of stretches: of bytes 128 bits, of words (their hashes) 64, a polynomial."""
    if x.dtype == np.uint8:
        view = x.data
        return pa.array([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist())], pa.binary())
    powers, back = (np.cumprod(np.full(len(x), f)) for f in (BASE, np.uint64(pow(int(BASE), -1, 2**64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers)])
    h = (sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)
    return _binary((h ^ (h >> np.uint64(31))) * BASE)


def _merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches covered by windows at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


def _packed(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, "<i4").tobytes()


RUN = T.StructType([T.StructField("rid", T.LongType()), T.StructField("start", T.LongType()), T.StructField("len", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("content", T.BinaryType())])
#: spilled: bytes that the sort of the row's shard kept in files.
FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("spans", T.BinaryType()), T.StructField("spilled", T.LongType())])


def row_keys(df: DataFrame, name: str = "rid") -> DataFrame:
    """Adds a number unique per row: doc_id if it is one, else a number from a written copy of the rows."""
    counts = df.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if counts.n == counts.d:
        return df.withColumn(name, F.col("doc_id").cast("long"))
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def find_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: rid, text. One row per run of windows with a common anchor, of either unit."""
    byte, word = units(length)

    def task(batches):
        for batch in batches:
            for part in _slices(batch):
                raws = [(t or "").encode("utf-8", "replace") for t in part.column("text").to_pylist()]
                rids = part.column("rid").to_numpy(zero_copy_only=False)
                for unit, texts in ((byte, [np.frombuffer(r, np.uint8) for r in raws]), (word, word_hashes(raws))):
                    for which, start, end, key, x, a, b in runs(texts, unit):
                        yield pa.RecordBatch.from_arrays([pa.array(rids[which]), pa.array(start), pa.array((end - start).astype(np.int32)), pa.array(key), _contents(x, a, b)], RUN.fieldNames())

    return docs.select("rid", "text").mapInArrow(task, RUN)


def _with_bytes(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: rid, start, len, key and others. Adds their bytes, cut from the texts or their words' hashes; a document's list is as long as its text at most."""
    others = [f for f in wanted.schema.fields if f.name not in ("rid", "start", "len")]
    names = [f.name for f in others]
    per_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "len", *names)).alias("runs"))
    schema = T.StructType([*others, T.StructField("raw", T.BinaryType())])

    def task(batches):
        for batch in batches:
            for part in _slices(batch):
                found = part.column("runs").flatten()
                start, size, key = (found.field(n).to_numpy(zero_copy_only=False) for n in ("start", "len", "key"))
                ends = np.cumsum(part.column("runs").value_lengths().to_numpy(zero_copy_only=False))
                raws = []
                for text, i, j in zip(part.column("text").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    raw = text.encode("utf-8", "replace")
                    words = key[i:j] & 1
                    hashes = word_hashes([raw])[0].tobytes() if words.any() else b""
                    step = 1 + 7 * words
                    raws += [hashes[a:b] if w else raw[a:b] for a, b, w in zip((start[i:j] * step).tolist(), ((start[i:j] + size[i:j]) * step).tolist(), words.tolist())]
                if raws:
                    yield pa.RecordBatch.from_arrays([*(found.field(n) for n in names), pa.array(raws, pa.binary())], [*names, "raw"])

    return docs.select("rid", "text").join(per_doc, "rid").select("text", "runs").mapInArrow(task, schema)


def sorted_spans(contents: list[tuple[int, bytes]], unit: Unit, spill: Spill) -> list[bytes]:
    """Repeated stretches of each of a shard's runs (occurrences, bytes), from the suffix order of all of them."""
    if unit.kind is np.uint8:
        text = np.concatenate([np.concatenate([np.frombuffer(raw, np.uint8) + np.uint8(2), np.ones(1, np.uint8)]) for _, raw in contents])  # UTF-8 has no bytes 254 and 255
        mark = repeated(text, unit.length, spill)
    else:
        words = [np.frombuffer(raw, unit.kind) for _, raw in contents]
        names = np.unique(np.concatenate(words), return_inverse=True)[1].astype(np.int32) + 2
        ends = np.cumsum([len(w) for w in words])
        names = np.concatenate([np.insert(names, ends, 1), [0]]).astype(np.int32)
        mark = repeated_names(names, int(names.max()) + 1, unit.length, spill)
    at, spans = 0, []
    for n, raw in contents:
        size = len(raw) // unit.size
        spans.append(_packed([(0, size)] if n > 1 else _merged(np.flatnonzero(mark[at : at + size - unit.length + 1]), unit.length)))
        at += size + 1
    return spans


def sort_shards(cut: DataFrame, length: int = LENGTH, shard: int = SHARD, budget: int = BUDGET) -> DataFrame:
    """cut: key, content, n (occurrences), raw. Stretches of each run that are repeated, from the suffix order of shards of one unit."""

    def task(batches):
        held, size, key = [], 0, 0

        def done():
            spill = Spill(budget)
            spans = sorted_spans([r[2:] for r in held], units(length)[key & 1], spill)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array(spans, pa.binary()), pa.array([spill.spilled] * len(held), pa.int64())], FOUND.fieldNames())

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (row[0] ^ key) & 1 or size >= shard and row[0] != key:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                key = row[0]
        if held:
            yield done()

    return cut.select("key", "content", "n", "raw").repartition("key").sortWithinPartitions(F.pmod("key", F.lit(2)), "key", "content").mapInArrow(task, FOUND)


def _anchor(x: np.ndarray, key: int, unit: Unit) -> int:
    """Where a run's anchor is: the first string with its key."""
    return int(np.flatnonzero(unit.key(_hashes(x, unit.anchor)) == key)[0])


def count_windows(cut: DataFrame, length: int, kept: list[DataFrame]) -> DataFrame:
    """The same for anchors with too many different runs, by digests dealt out on their own.

    Equal windows lie alike to their anchor, so runs are cut at fixed distances from it. The bytes that all windows of
    such a block have in common, its core, tell whether any of them can be repeated: a core that occurs once is done.
    Equal pieces are repeated in whole. The others are cut finer, down to single windows; of equal ones, one goes along
    for the others to match. A passage that many documents share costs a few rows per document, not one per window.
    Tables that the result reads are added to `kept`.
    """
    kinds_of = units(length)
    schema = T.StructType([*FOUND.fields[:2], T.StructField("n", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("rel", T.IntegerType()), T.StructField("raw", T.BinaryType()), T.StructField("solved", T.BooleanType())])
    cut_schema = T.StructType([*schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("core", T.BinaryType())])

    def start(batches):
        for batch in batches:
            key, content, n, raw = (batch.column(i).to_pylist() for i in range(4))
            rel = [_anchor(np.frombuffer(r, kinds_of[k & 1].kind), k, kinds_of[k & 1]) for k, r in zip(key, raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([0] * len(n), pa.int32()), pa.array(rel, pa.int32()), batch.column(3), pa.array([False] * len(n))], schema.fieldNames())

    def cutter(widths):
        def task(batches):
            for batch in batches:
                out = [[] for _ in cut_schema]
                for key, content, n, at, rel, raw, solved in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    unit, width = kinds_of[key & 1], widths[key & 1]
                    length, step = unit.length, unit.size
                    blocks = (rel - np.arange(len(raw) // step - length + 1)) // width
                    cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
                    for i, j in zip(cuts, cuts[1:]):
                        piece, low = raw[i * step : (j - 1 + length) * step], int(blocks[i]) * width
                        core = raw[(rel - low) * step : (rel - low - width + 1 + length) * step]
                        for values, v in zip(out, (key, content, n, at + i, rel - i, piece, solved, xxhash.xxh3_128_digest(piece), xxhash.xxh3_128_digest(core))):
                            values.append(v)
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], cut_schema.fieldNames())

        return task

    def pack(batches):
        for batch in batches:
            spans = [_packed([(s["at"], s["at"] + s["len"]) for s in found]) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary()), pa.array([0] * len(spans), pa.int64())], FOUND.fieldNames())

    pending, done, judged = cut.select("key", "content", "n", "raw").mapInArrow(start, schema), None, None
    for widths in ((64, 16), (16, 8), (4, 4), (1, 1)):  # of bytes, of words
        pieces = stored(pending.mapInArrow(cutter(widths), cut_schema), "pieces")
        if judged is not None:
            drop(judged)
        if widths != (1, 1):  # a single window is its own core
            cores = stored(pieces.groupBy("core").agg(F.sum("n").alias("total")).where("total > 1").select("core"), "cores")
            fewer = stored(pieces.join(cores, "core", "left_semi").select(*cut_schema.fieldNames()), "pieces")
            drop(pieces, cores)
            pieces = fewer
        often = stored(pieces.groupBy("digest").agg(F.sum("n").alias("total"), F.min(F.struct("content", "at")).alias("first")).where("total > 1").select("digest", "first"), "often")
        judged = stored(pieces.join(often, "digest", "left").drop("digest", "core"), "judged")
        drop(pieces, often)
        again = judged.where("first is not null and not solved").select("key", "content", "at", F.when(F.pmod("key", F.lit(2)) == 0, F.length("raw")).otherwise(F.length("raw") / kinds_of[1].size).cast("int").alias("len"))
        kept.append(again := stored(again, "again"))
        done = again if done is None else done.union(again)
        names = schema.fieldNames()
        one = judged.where((F.col("first.content") == F.col("content")) & (F.col("first.at") == F.col("at"))).withColumn("solved", F.lit(True)).withColumn("n", F.lit(2).cast("long"))
        pending = judged.where("first is null and not solved").select(*names).union(one.select(*names))
    drop(judged)
    return done.groupBy("key", "content").agg(F.collect_list(F.struct("at", "len")).alias("found")).mapInArrow(pack, FOUND)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard: int = SHARD, budget: int = BUDGET) -> DataFrame:
    """docs: rid, text. rid, found: array of (start, spans, words): repeated stretches relative to start, in words or bytes."""
    every = stored(find_runs(docs, length), "runs")
    distinct = stored(every.groupBy("key", "content").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("rid", "start", "len")]), "contents")
    keys = distinct.groupBy("key").agg(F.count("*").alias("contents"), F.sum("n").alias("total")).where("total > 1")
    shared = stored(distinct.join(keys.select("key", "contents"), "key"), "shared")
    drop(distinct)
    once = shared.where("contents = 1").select("key", "content", F.lit(None).cast("binary").alias("spans"))
    different = stored(_with_bytes(shared.where("contents > 1").select("key", "content", "n", "contents", "rid", "start", "len"), docs), "different")
    kept = [different]
    found = sort_shards(different.where(F.col("contents") <= hot), length, shard, budget).drop("spilled")
    too_many = different.where(F.col("contents") > hot)
    if too_many.limit(1).count():
        found = found.union(count_windows(too_many, length, kept).drop("spilled"))
    found = stored(found.where(F.length("spans") > 0).union(once), "found")
    drop(shared, *kept)
    one = F.struct("start", "len", "spans", (F.pmod("key", F.lit(2)) == 1).alias("words"))
    return every.join(found, ["key", "content"]).groupBy("rid").agg(F.collect_list(one).alias("found"))


def _stretches(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(2 * row + 1 for words, start, end) of the maximal stretches that the runs' repeated parts cover; parts that touch are one."""
    lists = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    one = found.flatten()
    start, size, words = (one.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "len", "words"))
    place = 2 * np.repeat(np.arange(len(lists)), lists) + words
    spans = one.field("spans")
    whole = spans.is_null().to_numpy(zero_copy_only=False)
    parts = pa.compute.binary_length(spans).fill_null(0).to_numpy(zero_copy_only=False) // 8
    cut = np.frombuffer(b"".join(spans.drop_null().to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
    rows = np.repeat(np.arange(len(start)), parts)
    g, a, b = (np.concatenate(x) for x in ((place[whole], place[rows]), (start[whole], start[rows] + cut[:, 0]), ((start + size)[whole], start[rows] + cut[:, 1])))
    if not len(g):
        return g, a, b
    order = np.lexsort((a, g))
    g, a, b = g[order], a[order], b[order]
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + g * far)
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] + g[1:] * far > reach[:-1])]))
    last = np.concatenate([first[1:], [len(g)]]) - 1
    return g[first], a[first], reach[last] - g[last] * far


def deduplicate(df: DataFrame, length: int = LENGTH, hot: int = HOT, shard: int = SHARD, budget: int = BUDGET) -> DataFrame:
    """df: doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), n_passages and passage_words.

    The last two count the stretches of words in which every word lies in a passage of over 50 words that starts
    anywhere else too, and their words; they remove nothing.
    """
    docs = row_keys(df.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    spans = repeated_spans(docs, length, hot, shard, budget)
    numbers = ("n_bytes", "n_removed", "n_spans")
    more = ("n_passages", "passage_words")
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in more]])

    def task(batches):
        for batch in batches:
            for part in _slices(batch):
                g, a, b = _stretches(part.column("found"))
                n = part.num_rows
                count = np.bincount(g, minlength=2 * n).reshape(n, 2)
                total = np.bincount(g, b - a, minlength=2 * n).astype(np.int64).reshape(n, 2)
                cuts = np.flatnonzero(g % 2 == 0)
                ends = np.cumsum(count[:, 0])
                sizes, kept = [], []
                for text, i, j in zip(part.column("text").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    raw, own = text.encode("utf-8", "replace"), cuts[i:j]
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[x:y] for x, y in zip([0, *b[own].tolist()], [*a[own].tolist(), len(raw)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(total[:, 0]), pa.array(count[:, 0]), pa.array(kept, pa.binary()), pa.array(count[:, 1]), pa.array(total[:, 1])], schema.fieldNames())

    return docs.select("rid", "doc_id", "text").join(spans, "rid", "left").select("doc_id", "text", "found").mapInArrow(task, schema)
