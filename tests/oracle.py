"""Compares registered queries with their DuckDB statements.

    python tests/oracle.py [--sf DIR] [--list] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time
import warnings

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _comparable(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype == object or str(frame[name].dtype) in ("string", "str"):
            frame[name] = frame[name].map(lambda v: "<null>" if v is None or v != v else str(v))
        elif str(frame[name].dtype).lower().startswith(("int", "uint", "float")):
            frame[name] = frame[name].astype("float64")
        else:
            frame[name] = frame[name].astype(str)
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} vs {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows vs {len(wanted)}"
    left, right = _comparable(got), _comparable(wanted)
    for name in left.columns:
        if left[name].dtype != right[name].dtype:
            return f"type of {name}: {got[name].dtype} vs {wanted[name].dtype}"
    unequal = [n for n in left.columns if not left[n].fillna(-9e99).equals(right[n].fillna(-9e99))]
    if unequal:
        rows = (left[unequal].fillna(-9e99) != right[unequal].fillna(-9e99)).any(axis=1)
        first = rows.idxmax()
        return f"{rows.sum()} rows in {unequal}, e.g. {left.loc[first].tolist()} vs {right.loc[first].tolist()}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    warnings.simplefilter("ignore")

    import __spark_entry__ as entry
    from vectorloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(arguments.sf)
    queries, statements = entry.queries(), entry.oracle_sql()
    failed = []
    for name in arguments.names or queries:
        started = time.time()
        try:
            got = queries[name](spark, arguments.sf).toPandas()
            took = time.time() - started
            if name not in statements:
                verdict = f"rows only: {len(got)}" if len(got) else "NO ROWS"
            else:
                before = time.time()
                wanted = connection.execute(statements[name]).df()
                found = differences(got, wanted)
                verdict = f"FAIL {found}" if found else f"ok {len(got)} rows"
                verdict += f" (sql {time.time() - before:.1f}s)"
                if found:
                    failed.append(name)
        except Exception as error:
            took = time.time() - started
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            failed.append(name)
        print(f"{name:32s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
