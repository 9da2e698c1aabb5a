"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are exact patterns and always kept. Looser candidates (credentials, national
numbers without a plus sign, spelled-out addresses) are voted on by labelers: a shape pattern, a gazetteer of keys,
the words before the span, its characters, and its variety. Expectation-maximisation over the counts of vote
patterns of all documents estimates each labeler's reliability per class; the posteriors train a logistic span
classifier on votes and shape features, which decides about each candidate.

What reaches the driver is the full count of each vote pattern for the EM, and one row per (vote pattern, shape): at
most MAX_PATTERNS rows, commonest first, train the classifier (a documented bound of the fit); the classifier then
judges every candidate of every text.

Null texts count as empty. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import map_texts, slices, stored

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "number", "address")
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}
MAX_PATTERNS = 5000

# Fixed by the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches end where digits end, so they begin where digits begin; taken whole, long runs of digits cost no more than reading them.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What every base span and every candidate has at least one of.
ANY = re.compile(r"[0-9@=:(\[]").search
SECRET = re.compile(r"\b([A-Za-z][A-Za-z_]{2,}+)[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_-]{8,}+)[\"']?")
NUMBER = re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")
ADDRESS = re.compile(r"\b[A-Za-z0-9._]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,10}\b")
#: Gazetteers.
KEYS = frozenset("password passwd pwd passphrase token secret apikey api_key key access_token auth credential ssn iban pin".split())
CUES = frozenset("phone tel telephone mobile call fax ssn social passport account iban contact mail email reach".split())
COUNTER_CUES = frozenset("version page section isbn figure table chapter line order total sum price year".split())
N_LABELERS = 5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's spans as (start, end, kind), by start and then kind as listed."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and _luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, tuple, str]]:
    """(start, end, kind, votes, shape) of looser spans that overlap no base span. Votes: 1 for, -1 against, 0 abstains."""
    found = []
    for kind, pattern in (("secret", SECRET), ("number", NUMBER), ("address", ADDRESS)):
        for m in pattern.finditer(text):
            a, b = m.span(2) if kind == "secret" else m.span()
            if any(s < b and a < e for s, e, _ in base):
                continue
            value, key = text[a:b], m.group(1).lower() if kind == "secret" else ""
            digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
            before = re.findall(r"[a-z]+", text[max(0, m.start() - 32) : m.start()].lower())[-3:]
            if kind == "secret":
                shape = 1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9+/_-]{20,}", value) and digits else -1 if not digits else 0
                mixed = 1 if digits >= 2 and letters >= 2 else -1 if not digits else 0
            elif kind == "number":
                shape = 1 if re.fullmatch(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{2}-\d{4}", value) else -1 if digits < 7 else 0
                mixed = 1 if 9 <= digits <= 15 else -1 if digits < 7 else 0
            else:
                shape, mixed = 1, 1 if not digits or letters > digits else 0
            gazetteer = 1 if key in KEYS or any(w in CUES for w in before) else -1 if key else 0
            context = 1 if any(w in CUES or w in KEYS for w in before) else -1 if any(w in COUNTER_CUES for w in before) else 0
            variety = -1 if len(set(value)) <= 3 else 1 if len(set(value)) >= 7 else 0
            pattern_shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", value))))[:8]
            found.append((a, b, kind, (shape, gazetteer, context, mixed, variety), pattern_shape))
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def vote_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, votes, shape, n: how often each vote pattern occurs in all texts (summed in the tasks first)."""
    schema = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("shape", pa.string()), ("n", pa.int64())])

    def task(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column(0).to_pylist():
                    if text and ANY(text):
                        seen.update((k, ",".join(map(str, v)), s) for _, _, k, v, s in candidates(text, base_spans(text)))
            if len(seen) > 50_000:
                yield _counted(seen, schema)
                seen.clear()
        yield _counted(seen, schema)

    return df.select(F.col(text_col).alias("text")).mapInArrow(task, "kind string, votes string, shape string, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def _counted(seen, schema):
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], schema=schema)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes with votes independent given the class: (posterior per pattern, P(vote | class, labeler), prior)."""
    post = np.clip(0.5 + 0.15 * votes.sum(1), 0.05, 0.95)
    table, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((post * n).sum() / max(n.sum(), 1), 0.02, 0.98))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                m = votes[:, j] == v
                table[j, 1, v + 1] = (post * n)[m].sum() + 1
                table[j, 0, v + 1] = ((1 - post) * n)[m].sum() + 1
        table /= table.sum(2, keepdims=True)
        logs = [np.log(p) + sum(np.log(table[j, c, votes[:, j] + 1]) for j in range(votes.shape[1])) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, table, prior


def features(kind: str, votes: tuple, shape: str) -> np.ndarray:
    x = np.zeros(3 + 2 * N_LABELERS + 64 + 1)
    x[EXTRA.index(kind)] = 1
    for j, v in enumerate(votes):
        if v:
            x[3 + 2 * j + (v > 0)] = 1
    for i in range(len(shape)):
        for g in (shape[i], shape[i : i + 2]):
            x[3 + 2 * N_LABELERS + sum(ord(c) * 31**k for k, c in enumerate(g)) % 64] = 0.5
    x[-1] = 1
    return x


def train(counts: list[tuple[str, str, str, int]], votes_n: list[tuple[str, str, int]]) -> dict:
    """Labeler reliabilities from the full counts of kinds and votes; classifier weights from the pattern counts."""
    dim = 3 + 2 * N_LABELERS + 64 + 1
    if not counts:
        return {"weights": np.zeros(dim), "reliability": np.zeros((N_LABELERS, 2, 3)), "prior": 0.5}
    read = lambda v: tuple(map(int, v.split(",")))
    votes_n = sorted(votes_n)
    votes = [read(v) for _, v, _ in votes_n]
    posts, table, prior = reliabilities(np.array(votes), np.array([c for _, _, c in votes_n], float))
    by_votes = dict(zip(votes, posts))
    counts = sorted(counts)
    parsed = [(k, read(v), s) for k, v, s, _ in counts]
    n, post = np.array([c[3] for c in counts], float), np.array([by_votes[v] for _, v, _ in parsed])
    x, weight = np.array([features(*p) for p in parsed]), n / n.sum()
    w = np.zeros(dim)
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ ((p - post) * weight) + 1e-4 * w)
    return {"weights": w, "reliability": table, "prior": prior}


def fit(df: DataFrame, text_col: str = "text") -> dict:
    counts = stored(vote_counts(df, text_col), "votes")
    rows = counts.orderBy(F.desc("n"), "kind", "votes", "shape").limit(MAX_PATTERNS).collect()
    return train([tuple(r) for r in rows], [tuple(r) for r in counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()])


def all_spans(text: str | None, weights: np.ndarray, memo: dict) -> tuple[list, list]:
    """(base spans, all spans) of a text; base spans stay, accepted candidates that overlap none are added."""
    if not text or not ANY(text):
        return [], []
    base = base_spans(text)
    extra, last = [], -1
    for a, b, kind, votes, shape in candidates(text, base):
        key = (kind, votes, shape)
        if key not in memo:
            memo[key] = bool(features(*key) @ weights > 0)
        if memo[key] and a >= last:
            extra.append((a, b, kind))
            last = b
    return base, sorted(base + extra, key=lambda s: (s[0], ORDER[s[2]]))


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds base_spans and pii_spans, arrays of (kind, start, end)."""
    weights = model["weights"]

    def task():
        memo: dict = {}
        shown = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

        def apply(texts):
            found = [all_spans(t, weights, memo) for t in texts]
            return {"base_spans": [shown(b) for b, _ in found], "pii_spans": [shown(a) for _, a in found]}

        return apply

    return map_texts(df, text_col, task, [T.StructField("base_spans", SPAN), T.StructField("pii_spans", SPAN)], keep)


def mask(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Replaces every span by its kind in angle brackets (overlapping spans: by the first kind); other columns stay."""
    weights = model["weights"]

    def task():
        memo: dict = {}

        def masked(text):
            spans = all_spans(text, weights, memo)[1]
            if not spans:
                return text
            out, at = [], 0
            for a, b, kind in spans:
                if a >= at:
                    out += [text[at:a], f"<{kind}>"]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return lambda texts: {text_col: [masked(t) for t in texts]}

    columns = df.columns
    return map_texts(df, text_col, task, [T.StructField(text_col, T.StringType())]).select(*columns)
