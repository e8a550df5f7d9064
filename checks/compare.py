"""Runs queries against their SQL twins: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Same column order, row order and types on both sides."""
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[column]):
            df[column] = df[column].astype("datetime64[us]")
        elif not pd.api.types.is_numeric_dtype(df[column]):
            df[column] = df[column].astype(object).where(df[column].notna(), None)
    return df.sort_values(list(df.columns), ignore_index=True, key=lambda c: c.astype(str))


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    ours = normal(query(spark, sf_dir).toPandas())
    theirs = normal(con.execute(sql).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} vs {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    if len(ours) == 0:
        return "no rows"
    for column in ours.columns:
        same = (ours[column] == theirs[column]) | (ours[column].isna() & theirs[column].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{column}: {ours[column][i]!r} vs {theirs[column][i]!r} ({(~same).sum()} rows)"
        if ours[column].dtype.kind != theirs[column].dtype.kind:
            return f"{column}: type {ours[column].dtype} vs {theirs[column].dtype}"
    return None


def main() -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from feedloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += found is not None
        print(f"{name:32} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
