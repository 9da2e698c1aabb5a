"""Token ids as Simple-8b files: selectors pack varying counts of ids into 64-bit words.

Word: the top 4 bits select how many ids of which width the other 60 hold, lowest first. Selector 0 is an escape:
the next word is one id in full. Blocks of BLOCK ids are packed on their own; the offsets of their words let a reader
start at any block and decode all words of a selector at once.

File: MAGIC, words, then the footer (block word offsets, document ids with null flags, ids per document), then its
place and the counts. A task writes under a name of its own and renames, so a repeated task leaves one whole file.

Documents go into the files in ascending doc_id order (nulls first; equal ids by text). A null text has no ids but
the end id.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import gaps, scratch, slices

MAGIC = b"S8BW0001"
BLOCK = 256
#: Ids that a writer gathers before it packs them.
HELD = 3_000_000
#: Fixed by the format: ids and bits per id for selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
TAIL = struct.Struct("<QQQQ8s")
#: Bits of the ids up to 65,535.
_WIDTH = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
#: Chunks that a worker remembers the ids of.
CACHE_CHUNKS = 700_000
END_ID = 0
#: White space besides the space and the line break.
RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = ".,;:!?|$%&*#"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits per id; 61 stands for all widths that no lane has."""
    if ids.max() < 1 << 16:
        return _WIDTH[ids]
    out = np.where(ids < 2**52, np.ceil(np.log2(ids.astype(np.float64) + 1)), 61).astype(np.uint8)
    big = np.flatnonzero(ids >= 2**52)
    out[big] = [int(x).bit_length() for x in ids[big]]
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per block) of unsigned ids; all blocks advance together, a word at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.zeros(blocks * BLOCK + 64, np.uint64)
    flat[:n] = ids
    bits = np.zeros(len(flat), np.uint8)
    bits[:n] = _bits(ids)
    # The highest selector index tried last wins, so go from one id a word to sixty.
    choice = (bits <= 60).astype(np.uint8) * np.uint8(14)
    top, width = bits.copy(), 1
    for s in range(13, 0, -1):
        while width < COUNTS[s]:  # top[i]: most bits of ids i to i + width - 1
            step = min(width, int(COUNTS[s]) - width)
            np.maximum(top[: len(top) - step], top[step:], out=top[: len(top) - step])
            width += step
        np.copyto(choice, np.uint8(s), where=top <= WIDTHS[s])
    # Padding beyond a block is not the next block's: a word may only reach over the end where the file ends.
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at = np.arange(blocks) * BLOCK
    slots, sizes = [], np.zeros(blocks, np.int64)  # of each word: block, place there, first id, selector
    live = np.arange(blocks)
    while len(live):
        i = at[live]
        s = choice[i].astype(np.int64)
        left = ends[live] - i
        over = (COUNTS[s] > left) & (s > 0)
        s[over] = np.searchsorted(-COUNTS[1:], -left[over]) + 1  # fewer ids, in wider lanes
        slots.append((live, sizes[live], i, s))
        sizes[live] += 1 + (s == 0)
        at[live] = i + np.where(s == 0, 1, COUNTS[s])
        live = live[at[live] < ends[live]]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint64)
    block, place, first, selector = (np.concatenate(x) for x in zip(*slots))
    place += starts[block]
    for k in np.flatnonzero(np.bincount(selector)).tolist():
        m = np.flatnonzero(selector == k)
        i, to = first[m], place[m]
        if k == 0:
            out[to + 1] = flat[i]
            continue
        words = np.full(len(m), k << 60, np.uint64)
        for lane in range(int(COUNTS[k])):
            words |= flat[i + lane] << np.uint64(lane * int(WIDTHS[k]))
        out[to] = words
    return out, sizes


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive whole blocks."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == 0).any():  # what follows an escape is no selector
        skip, i, escapes = np.zeros(len(words), bool), 0, np.flatnonzero(sel == 0)
        for e in escapes:
            if e >= i:
                skip[e + 1] = True
                i = e + 2
        lead = ~skip
    else:
        lead = np.ones(len(words), bool)
    where = np.flatnonzero(lead)
    s = sel[where]
    counts = np.where(s == 0, 1, COUNTS[s])
    starts = np.cumsum(counts) - counts
    out = np.zeros(max(n, int(counts.sum())), np.uint64)
    for k in np.unique(s):
        m = np.flatnonzero(s == k)
        if k == 0:
            out[starts[m]] = words[where[m] + 1]
            continue
        c, w = int(COUNTS[k]), int(WIDTHS[k])
        lanes = np.arange(c)
        out[starts[m][:, None] + lanes] = (words[where[m]][:, None] >> (lanes * w).astype(np.uint64)) & np.uint64((1 << w) - 1)
    return out[:n]


class Writer:
    """Streams documents into one file."""

    def __init__(self, folder: str, part: int):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temp = f"{root}/part-{part:06d}.s8b", f"{root}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.sizes, self.ids, self.null, self.counts = [], [], [], []
        self.rest, self.held = [], 0
        self.n = 0

    def add(self, doc_ids: list, arrays: list[np.ndarray]) -> None:
        self.ids += [x or 0 for x in doc_ids]
        self.null += [x is None for x in doc_ids]
        self.counts += map(len, arrays)
        self.rest += arrays
        added = sum(map(len, arrays))
        self.n, self.held = self.n + added, self.held + added
        if self.held >= HELD:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            self._pack(ids[:whole])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _pack(self, ids):
        if len(ids):
            words, sizes = pack(ids)
            self.out.write(words.astype("<u8").tobytes())
            self.sizes.append(sizes)

    def close(self) -> None:
        self._pack(np.concatenate([np.zeros(0, "<u4"), *self.rest]))
        sizes = np.concatenate([np.zeros(1, np.int64), *self.sizes])
        place = self.out.tell()
        for x, kind in ((np.cumsum(sizes), "<u8"), (self.ids, "<i8"), (self.null, "u1"), (self.counts, "<u8")):
            self.out.write(np.asarray(x).astype(kind).tobytes())
        self.out.write(TAIL.pack(place, len(sizes) - 1, len(self.ids), self.n, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


def read_file(uri: str, blocks_at_once: int = 1024):
    """Yields (document ids, None where null; ids per document; all their ids) for runs of documents of a file."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        place, n_blocks, n_docs, n, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        foot = f.read_at(size - TAIL.size - place, place)
        offsets = np.frombuffer(foot, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        doc_ids = np.frombuffer(foot, "<i8", n_docs, at)
        null = np.frombuffer(foot, "u1", n_docs, at + 8 * n_docs)
        counts = np.frombuffer(foot, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        ends = np.cumsum(counts)
        held, held_from, doc = np.zeros(0, "<u4"), 0, 0
        for b in range(0, n_blocks, blocks_at_once):
            e = min(n_blocks, b + blocks_at_once)
            raw = f.read_at(8 * int(offsets[e] - offsets[b]), len(MAGIC) + 8 * int(offsets[b]))
            ids = unpack(np.frombuffer(raw, "<u8"), min(n, e * BLOCK) - b * BLOCK)
            held = np.concatenate([held, ids.astype("<u4" if not len(ids) or ids.max() < 2**32 else "<u8")])
            upto = int(np.searchsorted(ends, held_from + len(held), "right"))
            if upto > doc:
                stop = int(ends[upto - 1]) - held_from
                yield [None if z else int(x) for x, z in zip(doc_ids[doc:upto], null[doc:upto])], counts[doc:upto], held[:stop]
                held, held_from, doc = held[stop:], held_from + stop, upto


_WORKER: dict = {}


class ByteBpe:
    """Whole-text ids by the tokenizers library, remembered per chunk.

    The byte-level pre-tokenizer always begins a new token at a single white-space character, so a text is cut there
    and its chunks (a space and a word, or a line break and a word) are encoded on their own, each once. Letters and
    punctuation are tokens apart; those go straight to the library's model. Texts with a special token's string or
    with white space in a row go to the library whole.
    """

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(raw)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        # Fixed by byte-level BPE: printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.letters = {x: chr(256 + i) for i, x in enumerate(hidden)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, text: str) -> bytes:
        """Ids of a space or nothing and letters, one token of the pre-tokenizer."""
        mapped = ("\u0120" + text[1:] if text[0] == " " else text) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _learn(self, chunks, known: dict[str, bytes], lead: str = "") -> None:
        """chunks: a word, or a line break and a word. Words (not those after a line break) come after lead, a space or nothing."""
        odd, tails = [], self.tails
        for c in chunks:
            line = c[0] == "\n"
            stem = c.rstrip(PUNCTUATION)
            if not (stem[1:] if line else stem).isalpha():
                odd.append(c)
                continue
            tail = c[len(stem) :]
            if tail not in tails:
                if len(tails) > 10_000:
                    tails.clear()
                    tails[""] = b""
                tails[tail] = self._ids([tail])[0]
            if (ids := known.get(stem)) is None:  # without the punctuation it may be known already
                ids = known[stem] = self.newline + self._letters(stem[1:]) if line else self._letters(lead + stem)
            if tail:
                known[c] = ids + tails[tail]
        for i in range(0, len(odd), 1000):
            part = odd[i : i + 1000]
            known.update(zip(part, self._ids([c if c[0] == "\n" else lead + c for c in part])))

    def _remember(self, chunks: set[str]) -> None:
        if len(self.rest) + len(chunks) > CACHE_CHUNKS:  # the oldest half has the commonest
            self.rest = dict(islice(self.rest.items(), CACHE_CHUNKS // 2))
        self._learn(chunks, self.rest, " ")

    def encode(self, texts: list) -> list[bytes]:
        if not hasattr(self, "newline"):
            self.newline = self._ids(["\n"])[0]
        whole, out = [], []
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
                continue
            shown = text.replace("\n", " \n")
            if shown[0] == " " or shown[-1] in " \n" or "  " in shown or "\n " in shown or any(c in text for c in RARE) or any(s in text for s in self.special):
                out.append(b"")  # white space in a row, at an end or of another kind
                whole.append(i)
            else:
                head, *chunks = shown.split(" ")
                parts = list(map(self.rest.get, chunks))
                missing = gaps(parts)
                if missing:
                    self._remember({chunks[j] for j in missing})
                    for j in missing:
                        parts[j] = self.rest[chunks[j]]
                if head not in self.first:
                    if len(self.first) > 50_000:
                        self.first.clear()
                    self._learn([head], self.first)
                out.append(self.first[head] + b"".join(parts))
        if whole:
            for i, x in zip(whole, self._ids([texts[i] for i in whole])):
                out[i] = x
        return out


def tokenizer(raw: str) -> ByteBpe:
    key = hash(raw)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ByteBpe(raw)
    return _WORKER[key]


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """Encodes and writes all documents; returns (part, documents, ids) per file, in order.

    What reaches the driver is a row per file.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()

    def task(batches):
        bpe, out, part = tokenizer(raw), None, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = [np.frombuffer(x + end, "<u4") for x in bpe.encode(piece.column("text").to_pylist())]
                out = out or Writer(folder, part)
                out.add(piece.column("doc_id").to_pylist(), ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(out.ids)], "n_ids": [out.n]}, pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    placed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in placed.mapInArrow(task, "part long, n_docs long, n_ids long").collect())


FILE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_token_files(spark, folder: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the unsigned crc32 of its ids."""
    rows, start = [], 0
    for part, _, n in parts:
        rows.append((f"{folder}/part-{part:06d}.s8b", start))
        start += n
    if not rows:
        return spark.createDataFrame([], FILE_SCHEMA)

    def task(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_ids, counts, ids in read_file(uri):
                    ends = np.cumsum(counts)
                    begin = ends - counts
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin + at), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)
                    at += int(ends[-1])

    files = spark.createDataFrame(rows, "uri string, start long").repartition(len(rows))
    return files.mapInArrow(task, FILE_SCHEMA)


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids and returns what the files hold; see FILE_SCHEMA."""
    folder = scratch(df.sparkSession, "tokens")
    return read_token_files(df.sparkSession, folder, write_token_files(df, folder, tokenizer_path, end_id))
