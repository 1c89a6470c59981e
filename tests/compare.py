"""Run registered queries beside their oracle SQL: ``python tests/compare.py [sf] [name...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(_plain(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def kind(v) -> str:
    return "null" if v is None else type(v).__name__


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    """What differs, empty when all is equal; values are compared exactly, types by kind."""
    left, right = sorted(spark_df.columns), sorted(sql_df.columns)
    if left != right:
        return [f"columns {left} != {right}"]
    a, b = rows_of(spark_df), rows_of(sql_df)
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    out = []
    for x, y in zip(a, b):
        if x != y or [kind(v) for v in x] != [kind(v) for v in y]:
            out.append(f"{dict(zip(left, x))}\n   != {dict(zip(left, y))}")
    return out


def main() -> None:
    import __spark_entry__ as e
    from borehole.session import local_session, scratch_scope

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.001")
    names = sys.argv[2:] or list(e.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if limit := os.environ.get("MAX_GROUP_ROWS"):  # small values force the split-group plans
        spark.conf.set("spark.borehole.maxGroupRows", limit)
    con = oracle(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            with scratch_scope(spark):
                got = e.queries()[n](spark, sf).toPandas()
            took = time.time() - t
            sql = e.oracle_sql().get(n)
            diff = differences(got, con.execute(sql).df()) if sql else []
            state = "ok" if not diff else f"DIFF {len(diff)}"
            if sql is None:
                state = "rows only"
            print(f"{n:40s} {len(got):8d} rows {took:7.2f}s  {state}", flush=True)
            for d in diff[:3]:
                print("   ", d)
            bad += bool(diff)
            if len(got) == 0:
                print("    NO ROWS")
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"{n:40s} FAILED {type(ex).__name__}: {str(ex)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
