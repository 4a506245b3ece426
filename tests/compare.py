"""Compare a Spark result with the SQL twin run by DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "DATE": "date", "FLOAT": "float",
    "HUGEINT": "hugeint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def differences(df, sql: str, con) -> str | None:
    """None when names, types, row count and rows agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(names)}"
    types = dict(df.dtypes)
    for n in names:
        want = _TYPES.get(described[n], described[n])
        if types[n] != want:
            return f"type of {n}: spark {types[n]} sql {described[n]}"
    order = sorted(names)
    ours = Counter(tuple(_plain(r[n]) for n in order) for r in df.collect())
    place = [names.index(n) for n in order]
    other = Counter(tuple(_plain(r[i]) for i in place) for r in theirs)
    if ours == other:
        return None
    extra, missing = ours - other, other - ours
    return (
        f"rows: spark {sum(ours.values())} sql {sum(other.values())}; {order}; "
        f"only spark {list(extra.items())[:3]}; only sql {list(missing.items())[:3]}"
    )
