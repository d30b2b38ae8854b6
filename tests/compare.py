"""Compare a Spark result with DuckDB's answer to its SQL, as a set of rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        value = 0.0 if value == 0 else value
        return int(value) if value.is_integer() else value
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, con, sql):
    """None when equal, else a description of the first difference."""
    found = con.execute(sql)
    want_cols, want = rows([c[0] for c in found.description], found.fetchall())
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None
