"""Runs registered queries next to their SQL counterparts and compares rows as multisets."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when both hold the same rows under the same column names."""
    names = sorted(spark_rows.columns)
    if names != sorted(sql_rows.columns):
        return f"columns {names} against {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    if not len(spark_rows):
        return "no rows"
    # a column of whole numbers with nulls is a nullable integer on one side and may be a float on the other
    for c in names:
        if {spark_rows[c].dtype.kind, sql_rows[c].dtype.kind} == {"i", "f"} and any(str(t[c].dtype) == "Int64" for t in (spark_rows, sql_rows)):
            spark_rows, sql_rows = (t.assign(**{c: t[c].astype("Int64")}) for t in (spark_rows, sql_rows))
    keys = [c for c in names if spark_rows[c].dtype.kind != "f"] + [c for c in names if spark_rows[c].dtype.kind == "f"]
    left = spark_rows[keys].sort_values(keys).reset_index(drop=True)
    right = sql_rows[keys].sort_values(keys).reset_index(drop=True)
    for c in keys:
        if left[c].dtype.kind != right[c].dtype.kind:
            return f"type of {c}: {left[c].dtype} against {right[c].dtype}"
        off = left[c].ne(right[c]) & ~(left[c].isna() & right[c].isna())
        if off.any():
            at = off.idxmax()
            return f"{int(off.sum())} values of {c} differ, first {left.loc[at].to_dict()} against {right.loc[at].to_dict()}"
    return None


if __name__ == "__main__":
    from atomweave.session import local_session
    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con, sql = local_session(), duck(sf_dir), e.oracle_sql()
    for name, run in e.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            t0 = time.time()
            ours = run(spark, sf_dir).toPandas()
            t1 = time.time()
            theirs = con.execute(sql[name]).df() if name in sql else None
            t2 = time.time()
            verdict = "rows only" if theirs is None else difference(ours, theirs) or "same"
        except Exception as error:  # noqa: BLE001
            verdict, t1, t2 = f"ERROR {type(error).__name__}: {str(error)[:400]}", time.time(), time.time()
        print(f"{name:38s} {t1 - t0:7.2f} {t2 - t1:7.2f}  {verdict}", flush=True)
