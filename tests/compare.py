"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in sorted(value.items())})
    if value is None or isinstance(value, bool):
        return str(value)
    return str(value)


def normal(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    rows = spark_df.collect()
    mine = normal(spark_df.columns, rows)
    cur = con.execute(sql)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return (
            f"rows {len(mine[1])} vs {len(theirs[1])}; only spark {sorted(a - b)[:3]}; "
            f"only sql {sorted(b - a)[:3]}"
        )
    return None
