"""SentencePiece encoding and decoding by a forward search over a trie of distinct marked words.

The distinct marked words of a batch are sorted, which lists the leaves of their trie in depth-first order. The
forward states of a word's prefixes are kept on a stack; the next word reuses those of the prefix it shares.

Unigram models keep the best score and its last piece for each prefix (Viterbi). BPE models have no additive score:
for each prefix exactly one last piece is admissible, the one that follows the last piece of what stands before it
as the merges themselves would have it. That admissibility takes the place of the maximum; the rest is the same.

Nulls encode like the empty text, to no ids. A literal U+2581 counts as a space, as in the library.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuelake.llm.common import gaps, map_texts, remembers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers; the memory of a worker is bounded by it.
CACHE_WORDS = 700_000


def _fields(raw: bytes):
    """The (number, value) fields of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[i : i + n]
            i += n


class PieceModel:
    """A SentencePiece model file (identity normalisation) with its encoder and decoder."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, self.dummy, self.squeeze = UNIGRAM, True, True
        name = ""
        for field, value in _fields(raw):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                name, self.dummy, self.squeeze = spec.get(1, b"").decode(), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if name not in ("", "identity") or self.squeeze:
            raise ValueError(f"normaliser {name!r} is not supported; only identity without space removal is")
        self.vocab = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unk = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.vocab))
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("a piece spans words")
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self._ends, self._after = {}, {}
        self._cache: dict[str, bytes] = {}

    # --- BPE -------------------------------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The merges themselves on a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                t = self.vocab.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.scores[t] > best[0]):
                    best = (self.scores[t], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _reversed(self) -> dict:
        """Trie of the reversed pieces that their own merges make; "" leads to the id."""
        if not self._ends:
            for p, t in self.vocab.items():
                if len(p) == 1 or (p.strip(MARK) and self._merged(p) == [p]):
                    node = self._ends
                    for c in reversed(p):
                        node = node.setdefault(c, {})
                    node[""] = t
        return self._ends

    def _follows(self, a: int, b: int) -> bool:
        if len(self._after) > 1_000_000:
            self._after.clear()
        x, y = self.pieces[a], self.pieces[b]
        out = self._after[a * 1048576 + b] = self._merged(x + y) == [x, y]
        return out

    def _walk_bpe(self, words: list[str]) -> dict[str, list[int]]:
        """words: sorted, without runs of marks. Unknown characters have negative states."""
        out, last, before = {}, [0], ""
        pieces, after, reverse = self.pieces, self._after, self._reversed()
        for w in words:
            n, k, m = len(w), 0, min(len(before), len(w))
            while k < m and w[k] == before[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, n + 1):
                # Pieces that end here, from the shortest: the trie of reversed pieces ends the search early.
                node, ends, j = reverse, [], i
                while j and (node := node.get(w[j - 1])) is not None:
                    j -= 1
                    if (t := node.get("")) is not None:
                        ends.append((j, t))
                state = None
                for j, t in reversed(ends):
                    if j == 0 or (p := last[j]) < 0:
                        state = t
                        break
                    if (ok := after.get(p * 1048576 + t)) is None:
                        ok = self._follows(p, t)
                    if ok:
                        state = t
                        break
                last.append(-ord(w[i - 1]) - 1 if state is None else state)
            ids, i = [], n
            while i:
                t = last[i]
                ids.append(t)
                i -= 1 if t < 0 else len(pieces[t])
            out[w] = ids[::-1]
            before = w
        return out

    # --- Unigram ---------------------------------------------------------------------------------------------

    def _walk_unigram(self, words: list[str]) -> dict[str, list[int]]:
        out, best, last, before = {}, [0.0], [0], ""
        vocab, pieces, scores = self.vocab, self.pieces, self.scores
        unknown = min(scores) - 10.0
        for w in words:
            n, k, m = len(w), 0, min(len(before), len(w))
            while k < m and w[k] == before[k]:
                k += 1
            del last[k + 1 :], best[k + 1 :]
            for i in range(k + 1, n + 1):
                top, state = best[i - 1] + unknown, -ord(w[i - 1]) - 1
                for j in range(max(0, i - self.longest), i):
                    t = vocab.get(w[j:i])
                    if t is not None and best[j] + scores[t] > top:
                        top, state = best[j] + scores[t], t
                best.append(top)
                last.append(state)
            ids, i = [], n
            while i:
                t = last[i]
                ids.append(t)
                i -= 1 if t < 0 else len(pieces[t])
            out[w] = ids[::-1]
            before = w
        return out

    # --- Words and texts ---------------------------------------------------------------------------------------

    def _spell(self, states: list[int]) -> list[int]:
        out = []
        for t in states:
            if t >= 0:
                out.append(t)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-t - 1).encode("utf-8", "replace")]
            else:
                out.append(self.unk)
        return out

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of distinct marked words: a run of marks, then anything without a mark."""
        runs = {w: len(w) - len(w.lstrip(MARK)) for w in words}
        plain = sorted({w[max(0, n - 1) :] if self.type == BPE else w for w, n in runs.items()} - {""})
        found = self._walk_bpe(plain) if self.type == BPE else self._walk_unigram(plain)
        out = {}
        for w, n in runs.items():
            if self.type != BPE or n < 2:
                out[w] = self._spell(found[w]) if w else []
                continue
            # Runs of marks merge last: first see whether the last mark went into the word.
            tail = found[w[n - 1 :]]
            alone = self.pieces[tail[0]] == MARK if tail[0] >= 0 else False
            marks = n if alone else n - 1
            out[w] = [self.vocab[p] for p in _marks(self, marks)] + self._spell(tail[1:] if alone else tail)
        return out

    def _learn(self, keys: set[str]) -> None:
        """A cache key is a word without its mark, or a line break and the unmarked word that begins a line."""
        words = {}
        for k in keys:
            words[k] = k[1:] if k[:1] == "\n" else MARK + k
        walk = self._walk_bpe if self.type == BPE else self._walk_unigram
        found = walk(sorted(set(words.values()) - {""}))
        found[""] = []
        lines = array("I", self._spell([-ord("\n") - 1] if "\n" not in self.vocab else [self.vocab["\n"]])).tobytes()
        cache = self._cache
        for k, w in words.items():
            ids = found[w]
            if not w.isascii() or min(ids, default=0) < 0:
                ids = self._spell(ids)
            cache[k] = lines + array("I", ids).tobytes() if k[:1] == "\n" else array("I", ids).tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, wanted = [], set()
        cache = self._cache
        for text in texts:
            if not text:
                split.append(None)
                continue
            shown = (" " * self.dummy + text).replace(MARK, " ").replace("\n", " \n")
            if self.dummy and "  " not in shown and shown[-1] != " ":
                keys = shown[1:].split(" ")
                parts = list(map(cache.get, keys))
                missing = gaps(parts)
                if missing:
                    wanted.update([keys[i] for i in missing])
                    split.append((keys, parts, missing))
                else:
                    split.append(b"".join(parts))
            else:
                split.append(shown.replace(" \n", "\n").replace(" ", MARK))
        if wanted:
            if len(cache) + len(wanted) > CACHE_WORDS:  # the oldest half has the commonest
                cache = self._cache = dict(islice(cache.items(), CACHE_WORDS // 2))
            self._learn(wanted)
        out = []
        for x in split:
            if isinstance(x, tuple):
                keys, parts, missing = x
                for i in missing:
                    parts[i] = cache[keys[i]]
                out.append(b"".join(parts))
            elif isinstance(x, str):
                words = re.findall(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+", x)
                found = self.encode_words(set(words))
                out.append(array("I", [i for w in words for i in found[w]]).tobytes())
            else:
                out.append(x or b"")
        return out

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


@lru_cache(maxsize=64)
def _runs(pieces: frozenset, n: int) -> tuple[str, ...]:
    parts = [MARK] * n
    i = 0
    while i < len(parts) - 1:  # all have one score, so the leftmost possible merge comes first
        if parts[i] + parts[i + 1] in pieces:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            i = max(0, i - 1)
        else:
            i += 1
    return tuple(parts)


def _marks(model: PieceModel, n: int) -> list[str]:
    if not hasattr(model, "_mark_pieces"):
        model._mark_pieces = frozenset(p for p in model.vocab if not p.strip(MARK))
        model._longest_run = max(map(len, model._mark_pieces), default=1)
    return list(_runs(model._mark_pieces, n))


_LOADED: dict[bytes, PieceModel] = {}
remembers(__name__, _LOADED.clear)


def load(raw: bytes) -> PieceModel:
    """The model of a worker process; it is kept from task to task."""
    key = raw[:64] + struct.pack("<Q", hash(raw) & (2**64 - 1))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(raw)
    return _LOADED[key]


def encode_documents(df: DataFrame, model_path: str, text_col: str = "text", decode: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds `piece_ids` (binary: little-endian unsigned 32-bit ids) and, if wanted, `decoded`, the text read back from them.

    The model file is read by the driver and sent along (its size is the vocabulary's, not the corpus').
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    fields = [T.StructField("piece_ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode

    def task():
        model = load(raw)

        def apply(texts):
            ids = model.encode(texts)
            return {"piece_ids": ids} | ({"decoded": [model.decode(x) for x in ids]} if decode else {})

        return apply

    return map_texts(df, text_col, task, fields, keep)


def decode_documents(df: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """The inverse: adds the text of a binary id column (null: null)."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def task():
        model = load(raw)
        return lambda ids: {out_col: [None if x is None else model.decode(x) for x in ids]}

    return map_texts(df, ids_col, task, [T.StructField(out_col, T.StringType())])
