"""Compares a query's rows with those of its SQL, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, db, query, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    cur = db.execute(sql)
    names, kinds = [c[0] for c in cur.description], {c[0]: str(c[1]) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    pairs = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}
    odd = [(c, k, kinds[c]) for c, k in df.dtypes if kinds[c] not in pairs.get(k, {kinds[c]})]
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; first {got[:2]}, not {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}" if bad else ("no rows" if not got else "")
