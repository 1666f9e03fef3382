"""Compares a Spark result with DuckDB's over the same files."""

import glob
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{where}'")
    return c


def rows(columns, values):
    keep = [[round(v, 6) if isinstance(v, float) else v for v in r] for r in values]
    return sorted((tuple(r) for r in keep), key=lambda r: [(x is None, str(x)) for x in r])


def assert_same(df, sql: str, sf_dir: str) -> None:
    found = views(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    ours = rows(columns, [[r[c] for c in columns] for r in df.collect()])
    theirs = rows(columns, [[r[names.index(c)] for c in columns] for r in found.fetchall()])
    assert len(ours) == len(theirs)
    assert ours == theirs
