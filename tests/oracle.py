"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
import numbers
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v) -> str:
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "null"
    if isinstance(v, numbers.Number) and str(v) not in ("True", "False"):
        return str(round(float(v), 6)) if math.isfinite(float(v)) else str(v)
    return str(v)


def canonical(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def check(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
