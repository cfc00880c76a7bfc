"""Spark result against DuckDB result, order-free and exact."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return str(value)


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, df.collect())


def duck_bag(con, sql: str):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return bag(columns, cur.fetchall())


def type_pairs(df, con, sql: str) -> list[tuple[str, str, str]]:
    """Columns whose types differ between the engines."""
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
    }
    have = dict(df.dtypes)
    want = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    return [(c, have[c], want.get(c, "-")) for c in have if names.get(have[c], have[c]) != want.get(c)]
