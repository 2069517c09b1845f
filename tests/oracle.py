"""Compares a query with its SQL in DuckDB: columns, row count and values, whatever the order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "float": "FLOAT"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return str(value) if isinstance(value, datetime.datetime) else value


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if Path(path).is_dir() else path}')")
    return con


def compare(df, sql: str, con) -> None:
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    kinds = {x[0]: str(x[1]) for x in found.description}
    rows = found.fetchall()
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    wide = {n: (KINDS.get(k, k), kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]}
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    assert sum(mine.values()) == sum(theirs.values()), (sum(mine.values()), sum(theirs.values()))
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    assert not wide, wide
