"""Compare a query with its SQL in DuckDB, row for row."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of_sql(con, sql: str):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(row[i] for i in order) for row in got.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short text."""
    names, mine = rows_of_frame(df)
    other_names, theirs = rows_of_sql(con, sql)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if mine == theirs:
        return None
    missing, extra = theirs - mine, mine - theirs
    return (f"{sum(mine.values())} rows against {sum(theirs.values())}; "
            f"missing {list(missing.items())[:3]}; extra {list(extra.items())[:3]}")
