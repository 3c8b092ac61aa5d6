"""Rows of a query in Spark against its SQL in DuckDB, as multisets of values in columns sorted by name."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(float(r[i]) if isinstance(r[i], float) else int(r[i]) if isinstance(r[i], int) else r[i] for i in order) for r in rows)


def difference(df, con, sql):
    """None, or what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = multiset(df.columns, df.collect()), multiset(names, result.fetchall())
    if a == b:
        return None
    return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
