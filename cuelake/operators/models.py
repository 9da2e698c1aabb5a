"""Interfaces to models, with deterministic stand-ins that need no network.

`provider` makes a column function of any client that takes lists of texts: batches, retries and smaller batches when
memory runs out. The other functions have the same columns in and out and are what runs without one.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.text import TRANSIENT_MARKS, TRANSIENT_STATUS, query_tokens

DIMENSION = 384


def is_transient(error: Exception) -> bool:
    return getattr(error, "status_code", None) in TRANSIENT_STATUS or bool(re.search(TRANSIENT_MARKS, str(error).lower()))


def call_in_batches(call: Callable[[list], list], texts: list, batch: int, retries: int, wait: float) -> list:
    """Results of all texts. Transient failures are tried again after waits that double; a batch that memory does not hold is halved."""
    out, at, tried = [], 0, 0
    while at < len(texts):
        part = texts[at : at + batch]
        try:
            got = list(call(part))
        except Exception as error:  # noqa: BLE001  clients have their own classes
            if (isinstance(error, MemoryError) or "out of memory" in str(error).lower()) and len(part) > 1:
                batch = len(part) // 2
                continue
            if tried >= retries or not is_transient(error):
                raise
            time.sleep(wait * 2**tried * random.uniform(0.5, 1))
            tried += 1
            continue
        if len(got) != len(part):
            raise ValueError(f"{len(got)} results for {len(part)} texts")
        out += got
        at, tried = at + len(part), 0
    return out


def provider(load: Callable[[], Callable[[list], list]], returns: T.DataType, batch: int = 32, retries: int = 5, wait: float = 1.0, prefix: str = ""):
    """A column function of one or more text columns. `load` makes the client, once a task; the client takes a list of texts (of tuples, if there are several columns) and returns a list.

    A row with a null text is not sent and has a null result. A failure that is not transient, or stays, fails the task,
    which Spark runs again.
    """

    def column(*columns: Column) -> Column:
        @F.pandas_udf(returns)
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            client = load()
            for part in parts:
                part = part if isinstance(part, tuple) else (part,)
                rows = list(zip(*part))
                good = [i for i, r in enumerate(rows) if all(isinstance(x, str) for x in r)]
                sent = [prefix + rows[i][0] if len(part) == 1 else rows[i] for i in good]
                out = pd.Series([None] * len(rows), dtype=object)
                for i, x in zip(good, call_in_batches(client, sent, batch, retries, wait)):
                    out.iat[i] = x
                yield out

        return run(*columns)

    return column


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hashed words, scaled to length one; a null text has no vector."""

    def one(text):
        if text is None:
            return None
        v = np.zeros(DIMENSION, np.float32)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % DIMENSION] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    for series in texts:
        yield series.map(one)


def overlap(query: Column, text: Column) -> Column:
    """Rerank score: share of the query's distinct words in the text."""
    q = F.array_distinct(query_tokens(query))
    return F.round(F.size(F.array_intersect(q, query_tokens(text))) / F.nullif(F.size(q), F.lit(0)), 6)


def extract_answer(query: Column, text: Column) -> Column:
    """The sentence that shares most words with the question; the first of equals."""
    q = F.array_distinct(query_tokens(query))
    sentences = F.split(text, r"(?<=[.!?])\s+")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(q, query_tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def unfence(reply: Column) -> Column:
    """JSON out of a fenced reply."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
