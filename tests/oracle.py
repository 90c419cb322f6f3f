"""Runs a query and its SQL side by side."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def frame(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    norm = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else (round(float(v), 5) + 0.0 if isinstance(v, float) else (str(v) if hasattr(v, "__len__") and not isinstance(v, str) else (int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v)))
    return sorted((tuple(norm(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    ours = query(spark, sf_dir).toPandas()
    theirs = duck(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns), (sorted(ours.columns), sorted(theirs.columns))
    a, b = frame(ours), frame(theirs)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
