"""Compares a query's rows with its DuckDB SQL's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in df[cols].itertuples(index=False))
