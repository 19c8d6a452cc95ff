"""Rows of a query and of its SQL as comparable multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    return f"{x:.6g}" if isinstance(x, float) and not math.isnan(x) else str(x)


def of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())


def of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_cell(row[i]) for i in order) for row in cur.fetchall())
