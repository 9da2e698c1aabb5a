"""Runs a query and its SQL side by side and compares columns, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    return str(v)


KINDS = {"bigint": "long", "hugeint": "long", "integer": "int", "varchar": "string", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    kinds = dict(df.dtypes)
    for d in rel.description:
        theirs_kind = KINDS.get(str(d[1]).lower(), None)
        ours_kind = {"bigint": "long"}.get(kinds[d[0]], kinds[d[0]])
        if theirs_kind and theirs_kind != ours_kind:
            return f"type of {d[0]}: {ours_kind} and {d[1]}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{dict(zip(names, a))}\nand\n{dict(zip(names, b))}"[:1500]
    return None
