"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set are one. Of the others, SimHash finds what may be linked: fingerprints of the sets that differ
in RADIUS bits or fewer and agree in all bits of one of KEYS keys, which are the longer the more fingerprints there are.
Texts connected so form a family. Within a family of one tile all pairs are compared on the whole sets. In a larger one
the edges that made it are compared first; then only texts that these have not connected are compared, by tiles of
bounded size: a group whose texts are linked to each other is never compared with itself, however large it is. Each pair
of tiles yields a spanning forest of its links. So rows grow with the table, and comparisons with the square of what a
family holds unlinked.

Neither the radius nor the keys hold for every pair at the threshold (it is about 10 bits apart on average, a few pairs
15 or more). For the rest there are MinHash bands: those that hold texts not linked so far make families that are
compared alike. Whatever SimHash finds or not, a pair at the threshold shares none of the BANDS bands of ROWS values with
a probability of 1.2e-7, a closer pair with less.

Words are those of the fingerprints; texts without words are copies of each other. Null texts count as empty. Rows with
a null doc_id link nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import begin, cut, drop, give_back, map_texts, stored
from cuelake.llm.components import connected_components
from cuelake.llm.simhash import key_links, majority, shingle_hashes, signed

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Bits by which fingerprints of candidates differ at most, and keys of which they share one.
RADIUS, KEYS = 11, 24
BANDS, ROWS, SEED = 40, 5, 17
#: Texts and shingles in a tile at most, about, and shingles whose common counts are made at a time.
TILE, HELD, COLUMNS = 1024, 1 << 19, 1024
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(found: np.ndarray) -> np.ndarray:
    """One key a band, none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, ((found[i : i + 1024, None] ^ _ODD[0]) * _ODD[1]).min(0))
    keys = ((least ^ (least >> np.uint64(29))) * _ODD[2]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return keys.view(np.int64)


def links(sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest, in ids, of the links among the sets, or between those of side 0 and of side 1 if both occur."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # what one text alone has is in no intersection
    use = times[column] > 1
    owner, column = owner[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = two if len(two) else one
    both = np.zeros((len(one), len(two)), np.int32)
    for start in range(0, int(times[times > 1].size), COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(column[j - 1]) - start + 1)), np.float32)
        held[owner[i:j], column[i:j] - start] = 1
        both += (held[one] @ held[two].T).astype(np.int32)  # exact: counts of COLUMNS at most
    label, a, b = np.arange(len(sets)), [], []
    for i, u in enumerate(one.tolist()):
        common = both[i].astype(np.int64)
        near = two[common * LEAST[1] >= (sizes[u] + sizes[two] - common) * LEAST[0]]
        while len(near := near[label[near] != label[u]]):  # each text joins once, however many links it has
            v = int(near[0])
            label[label == label[v]] = label[u]
            a.append(int(ids[u]))
            b.append(int(ids[v]))
    return a, b


def _compare(batches):
    """Links of each pair of tiles; rows pair, side, doc_id, found come sorted by pair."""
    begin(__name__)
    key, held = None, []

    def done():
        a, b = links([f for _, _, f in held], np.array([i for _, i, _ in held]), np.array([s for s, _, _ in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        found = batch.column(3)
        for k, (pair, *row) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            if pair != key:
                if held:
                    yield done()
                key, held = pair, []
            held.append((*row, np.frombuffer(found[k].as_buffer(), np.uint64)))
    if held:
        yield done()
    give_back()


def similar(one: np.ndarray, other: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(one) or not len(other):
        return len(one) == len(other)
    both = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return both * least[1] >= (len(one) + len(other) - both) * least[0]


def _compare_edges(batches):
    """Edges a, b of near copies; rows a, part, doc_id, found come sorted by a and part, with a's own set first."""
    begin(__name__)
    key, own = None, None
    for batch in batches:
        a, b, found = [], [], batch.column(3)
        for k, (*at, doc) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            s = np.frombuffer(found[k].as_buffer(), np.uint64)
            if at != key:
                key, own = at, s.copy()
            elif similar(own, s):
                a.append(at[0])
                b.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def families(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, family, n, tiles: the texts that edges a, b connect, and the number of tiles of their family. sizes: doc_id, n (shingles)."""
    family = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family")).distinct()
    family = stored(family.join(sizes, "doc_id"), "families")
    return family.join(family.groupBy("family").agg(_tiles("n").alias("tiles")), "family")


def _tiles(n: str, texts=None):
    """Tiles for rows with so many shingles (and, if a row stands for several, texts)."""
    return F.greatest(F.ceil((F.sum(texts) if texts else F.count("*")) / TILE), F.ceil(F.sum(n) / HELD))


def compared_edges(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the edges a, b that link near copies. sets: doc_id, found. A text with many edges is sent to several tasks."""
    hubs = edges.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    ends = edges.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("doc_id"))
    own = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    dealt = ends.union(own).join(sets.select("doc_id", "found"), "doc_id").select("a", "part", "doc_id", "found")
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.col("doc_id") != F.col("a")).mapInArrow(_compare_edges, "a long, b long")


def dealt_apart(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows pair, side, doc_id, found of the pairs of tiles that may hold links between texts not connected yet.

    sets: doc_id, family, n, found. linked: node, component. Components of more than a tile have tiles of their own, which
    are not compared with each other; the texts of the others share the rest of the family's tiles.
    """
    part = sets.join(linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = cut(part.groupBy("family", "component").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), _tiles("n").alias("own")))
    large = sizes.where("own > 1").select("family", "component", "own")
    rest = sizes.where("own = 1").groupBy("family").agg(_tiles("n", "texts").alias("shared"))
    name = lambda owner, i: F.concat_ws("-", F.coalesce(owner.cast("string"), F.lit("rest")), i)
    every = large.select("family", F.col("component").alias("owner"), "own").union(rest.select("family", F.lit(None).cast("long"), "shared"))
    others = every.select("family", F.col("owner").alias("theirs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("i"))
    others = others.select("family", "theirs", name(F.col("theirs"), F.col("i")).alias("other"))
    part = part.join(F.broadcast(large), ["family", "component"], "left").join(F.broadcast(rest), "family", "left")
    owner = F.when(F.col("own").isNotNull(), F.col("component"))
    mine = name(owner, F.pmod(F.xxhash64("doc_id"), F.coalesce("own", "shared")))
    part = part.select("family", "doc_id", "found", owner.alias("owner"), mine.alias("mine"))
    apart = F.coalesce(F.col("owner") != F.col("theirs"), F.lit(True))
    pair = F.concat_ws("|", "family", F.least("mine", "other"), F.greatest("mine", "other"))
    return part.join(F.broadcast(others), "family").where(apart).select(pair.alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc_id", "found")


def verified(edges: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges a, b of near copies that connect all near copies within the families that the given edges make, by whole sets."""
    whole = lambda part: {"found": [shingles(t).tobytes() for t in part]}
    edges = stored(edges, "candidates")
    members = texts.join(families(edges, sizes), "doc_id")
    sets = stored(map_texts(members, "text", lambda: whole, [T.StructField("found", T.BinaryType())], ["doc_id", "family", "n", "tiles"]), "shingles")
    dealt = sets.where("tiles = 1").select(F.col("family").cast("string").alias("pair"), F.lit(0).alias("side"), "doc_id", "found")
    large = sets.where("tiles > 1")
    direct = None
    if not large.isEmpty():
        first = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        first = first.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")
        direct = stored(compared_edges(first, large), "links")
        dealt = dealt.union(dealt_apart(large, connected_components(direct)))
    found = stored(dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(_compare, "a long, b long"), "links")
    drop(sets, edges)
    return found.union(direct) if direct else found


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """texts: doc_id, fp. Edges a, b that connect the texts with one fingerprint, and those of each key with fingerprints within the radius."""
    first = stored(texts.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    same = texts.join(first, "fp").where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return key_links(first, RADIUS, KEYS).union(same)


def by_bands(texts: DataFrame) -> DataFrame:
    """texts: doc_id, bands, linked. Edges a, b that connect the texts of every band with more than one value of linked."""
    rows = texts.select("doc_id", "linked", F.posexplode("bands").alias("band", "key"))
    first = rows.groupBy("band", "key").agg(F.min("doc_id").alias("first"), F.min("linked").alias("low"), F.max("linked").alias("high")).where("low < high")
    return rows.join(first, ["band", "key"]).where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_copies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df: doc_id (integer) and a text. Returns doc_id and component_id for every row."""
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batch):
        found = [shingles(t) for t in batch]
        return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "fp": [signed(majority(s)) for s in found], "bands": [bands(s) for s in found], "n": [len(s) for s in found]}

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]
    sketched = stored(map_texts(texts, "text", lambda: sketch, fields, ["doc_id"]), "sketches")
    docs = stored(sketched.select("doc_id", "digest"), "digests")
    one = stored(sketched.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min_by("bands", "doc_id").alias("bands"), F.min("n").alias("n")), "distinct")
    drop(sketched)
    sizes = one.select("doc_id", "n")
    linked = connected_components(verified(by_fingerprint(one.select("doc_id", "fp")), sizes, texts)).withColumnsRenamed({"node": "doc_id", "component": "linked"})
    known = stored(one.join(linked, "doc_id", "left").select("digest", "doc_id", F.coalesce("linked", "doc_id").alias("linked")), "linked")
    rest = verified(stored(by_bands(one.join(known.select("doc_id", "linked"), "doc_id")), "groups"), sizes, texts)
    drop(one)
    for end in ("a", "b"):
        rest = rest.join(known.select(F.col("doc_id").alias(end), F.col("linked").alias(f"of_{end}")), end)
    joined = connected_components(rest.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).withColumnsRenamed({"node": "linked"})
    by_digest = known.join(joined, "linked", "left").select("digest", F.coalesce("component", "linked").alias("component_id"))
    return docs.join(by_digest, "digest", "left").select("doc_id", "component_id")
