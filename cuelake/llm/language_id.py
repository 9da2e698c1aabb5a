"""Language identification by a byte convolutional network, trained in numpy.

Windows of WINDOW bytes pass an embedding, filters over 2, 3 and 4 bytes, a maximum over the window and a softmax.
Every window of a whole text counts; a text's probabilities are the mean over its windows. For prediction, embedding
and filters fold into tables over byte pairs, which give the same sums by look-up.

The network is fitted on at most PER_LANGUAGE texts of each language, chosen by hash (a documented bound); for each of
them at most TRAIN_WINDOWS windows, evenly spread. Prediction covers all bytes of all texts.
More languages than `most` are an error, as each has its own column in the network and its own texts in the sample.
A null text, or one without a letter, gets `und` and score 0. Without any labelled text everything is `und`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import map_texts

WINDOW, EMBED, FILTERS, SIZES = 256, 8, 16, (2, 3, 4)
PER_LANGUAGE, TRAIN_WINDOWS, MAX_LANGUAGES = 400, 6, 200
LETTER = re.compile(r"[^\W\d_]").search


def has_letter(text: str) -> bool:
    found = LETTER(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def windows(raw: bytes) -> np.ndarray:
    """All consecutive windows; the last is filled up with spaces. Neighbours overlap by the widest filter less one."""
    step = WINDOW - max(SIZES) + 1
    n = max(1, -(-(len(raw) - max(SIZES) + 1) // step))
    buf = np.full((n - 1) * step + WINDOW, 32, np.uint8)
    buf[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[::step]


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)), "v": rng.normal(0, 0.1, (FILTERS * len(SIZES), len(labels))), "c": np.zeros(len(labels))}
        for k in SIZES:
            self.p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        pooled, where = [], []
        for k in SIZES:
            cols = np.concatenate([e[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
            h = cols @ self.p[f"w{k}"]
            i = h.argmax(1)
            pooled.append(np.take_along_axis(h, i[:, None], 1)[:, 0] + self.p[f"b{k}"])
            where.append(i)
        a = np.concatenate(pooled, 1)
        r = np.maximum(a, 0)
        z = r @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return e, a, r, where, z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 3) -> None:
        rng, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        by = [np.flatnonzero(y == i) for i in range(len(self.labels))]
        by = [b for b in by if len(b)]
        for t in range(1, steps + 1):
            i = np.array([rng.choice(by[j]) for j in rng.integers(0, len(by), batch)])  # languages are drawn alike
            xb, yb = x[i], y[i]
            e, a, r, where, p = self._forward(xb)
            g = dict.fromkeys(self.p)
            dz = p.copy()
            dz[np.arange(batch), yb] -= 1
            dz /= batch
            g["v"], g["c"] = r.T @ dz, dz.sum(0)
            da = (dz @ self.p["v"].T) * (a > 0)
            g["e"] = np.zeros_like(self.p["e"])
            rows = np.arange(batch)[:, None]
            for n, k in enumerate(SIZES):
                d = da[:, n * FILTERS : (n + 1) * FILTERS]
                pos = where[n][:, :, None] + np.arange(k)  # batch, filter, tap
                took = e[rows[:, :, None], pos].reshape(batch, FILTERS, k * EMBED)
                g[f"w{k}"] = np.einsum("bfi,bf->if", took, d)
                g[f"b{k}"] = d.sum(0)
                de = np.einsum("bf,if->bfi", d, self.p[f"w{k}"]).reshape(batch, FILTERS, k, EMBED)
                np.add.at(g["e"], xb[rows[:, :, None], pos], de)
            for k, v in self.p.items():
                m1, m2 = m[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                v -= rate * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> dict:
        """Sums of the filters' taps per byte pair, for widths 2, 3 and 4, and the third tap of width 3 per byte."""
        e, f = self.p["e"], FILTERS
        tap = lambda k, j: e @ self.p[f"w{k}"][j * EMBED : (j + 1) * EMBED]
        pair = lambda k, j: (tap(k, j)[:, None, :] + tap(k, j + 1)[None]).reshape(65536, f)
        return {
            "pairs": np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], 1).astype(np.float32),
            "third": tap(3, 2).astype(np.float32),
            "b": np.concatenate([self.p[f"b{k}"] for k in SIZES]).astype(np.float32),
            "v": self.p["v"].astype(np.float32), "c": self.p["c"].astype(np.float32),
        }


def probabilities(x: np.ndarray, t: dict) -> np.ndarray:
    """x: windows. Rows of language probabilities."""
    f, out = FILTERS, []
    for i in range(0, len(x), 64):
        w = x[i : i + 64]
        g = t["pairs"][w[:, :-1].astype(np.int32) * 256 + w[:, 1:]]
        a2 = g[:, :, :f].max(1)
        a3 = (g[:, :-1, f : 2 * f] + t["third"][w[:, 2:]]).max(1)
        a4 = (g[:, :-2, 2 * f : 3 * f] + g[:, 2:, 3 * f :]).max(1)
        z = np.maximum(np.concatenate([a2, a3, a4], 1) + t["b"], 0) @ t["v"] + t["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        out.append(z / z.sum(1, keepdims=True))
    return np.concatenate(out)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MAX_LANGUAGES) -> ByteConvNet | None:
    """labelled: doc_id, text, lang. The languages' counts and at most about per_language texts of each reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; raise `most`")
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < min(1_000_000, int(1_000_000 * per_language / n) + 1)))
    sample = rows.where(chosen).select("doc_id", "lang", F.col("text").cast("string").alias("text")).limit(2 * per_language * len(counts)).collect()
    labels = sorted({r.lang for r in sample})
    xs, ys = [], []
    for r in sorted(sample, key=lambda r: (str(r.doc_id), r.lang)):
        if has_letter(r.text):
            w = windows(r.text.encode("utf-8", "replace"))
            w = w[np.unique(np.linspace(0, len(w) - 1, min(len(w), TRAIN_WINDOWS)).astype(int))]
            xs.append(w)
            ys += [labels.index(r.lang)] * len(w)
    if not xs:
        return None
    net = ByteConvNet(labels)
    net.train(np.concatenate(xs), np.array(ys))
    return net


def predict(df: DataFrame, net: ByteConvNet | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score."""
    folded = net and net.tables()
    shared = df.sparkSession.sparkContext.broadcast(folded)  # 17 MB, fixed by the network's shape
    labels = net.labels if net else []

    def task():
        t = shared.value

        def apply(texts):
            raws = [x.encode("utf-8", "replace") if t and x and has_letter(x) else None for x in texts]
            wins = [windows(r) for r in raws if r is not None]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if wins:
                p = probabilities(np.concatenate(wins), t)
                sizes = np.array([len(w) for w in wins])
                p = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                for i, row in zip((i for i, r in enumerate(raws) if r is not None), p):
                    k = int(row.argmax())
                    lang[i], score[i] = labels[k], float(min(1.0, row[k]))
            return {"lang_pred": lang, "score": score}

        return apply

    return map_texts(df, text_col, task, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
