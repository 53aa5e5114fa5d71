"""Runs a query and its SQL and compares the rows, columns by name."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def differences(spark, queries, oracles, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(oracles[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    want = sorted((tuple(_plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=repr)
    if got == want:
        return ""
    bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"{len(got)} and {len(want)} rows, first differences {bad}"
