"""Runs a query and its SQL over the same files and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> list:
    return [(v is not None, type(v).__name__ if isinstance(v, str) else "", v if v is not None else 0) for v in row]


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_plain(r[i]) for i in place) for r in rows]
    return sorted(columns), sorted(picked, key=_key)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and a SQL result; empty when they agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(names, cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    out = []
    for f in df.schema.fields:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != kinds[f.name]:
            out.append(f"type of {f.name}: {kind} != {kinds[f.name]}")
    if len(got) != len(want):
        return out + [f"rows {len(got)} != {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    close = all(
        all(
            a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9))
            for a, b in zip(g, w)
        )
        for g, w in bad
    )
    if bad:
        out.append(f"{len(bad)} rows differ{' (close)' if close else ''}, first: {str(bad[0])[:1500]}")
    return out
