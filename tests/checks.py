"""Comparison of a query with its DuckDB SQL."""

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def agree(df, sql: str, con) -> None:
    want = con.sql(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), names)
