"""What the training-data operators share: table access, shared scratch folders, batched text maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cuelake.registry import table  # noqa: F401
from cuelake.scratch import cut, drop, drop_since, left, remove, scratch, shared_dir, stored, write  # noqa: F401

#: Characters of text that a Python worker unpacks at a time; bounds its memory whatever the batch size is.
SLICE_CHARS = 2_000_000
#: Bytes that Spark sends to a Python worker at a time, about; the JVM and the worker hold several such batches a task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What operators remember in a Python worker from task to task, by module: how to forget it.
_FORGET: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's batches for Python workers are bounded by bytes, unless it has a bound of its own."""
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _FORGET[owner] = forget


def begin(owner: str) -> None:
    """To be called as a task of a module begins: what those of other modules remembered in this worker goes."""
    if owner != _OWNER[0]:
        for other, forget in _FORGET.items():
            if other != owner:
                forget()
        give_back()
        _OWNER[0] = owner


def give_back() -> None:
    """Memory that nothing uses goes back to the system, as other stages of the executor need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 64
    if start < len(sizes):
        yield batch.slice(start)


def gaps(parts: list) -> list[int]:
    """Where a list has None."""
    out, i = [], -1
    try:
        while True:
            i = parts.index(None, i + 1)
            out.append(i)
    except ValueError:
        return out


def map_texts(df: DataFrame, text_col: str, fn: Callable[[], Callable[[list], dict]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Adds columns computed from whole texts.

    `fn` is called once per task and returns a function from a list of texts (None for null) to a dict of
    columns. Columns of `df` named in `keep` (default: all) stay; one with the name of a new column is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    sent = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches):
        begin(fn.__module__)
        apply = fn()
        for batch in batches:
            for part in slices(batch, text_col):
                out = apply(part.column(text_col).to_pylist())
                cols = [part.column(c) for c in keep] + [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, kinds[f.name]) for f in fields]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])
        give_back()

    return bounded(df).select(*sent).mapInArrow(run, schema)


def free_name(taken: list[str], name: str) -> str:
    """The name, or the first of name_1, name_2 ... that no column has; names differ by more than case."""
    low, i, out = {c.lower() for c in taken}, 0, name
    while out.lower() in low:
        i += 1
        out = f"{name}_{i}"
    return out


def bucket(col: str, n: int):
    """The remainder that fixes train and test folds: unsigned crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
