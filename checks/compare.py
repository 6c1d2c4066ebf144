"""Run named queries in Spark and in DuckDB and report every difference."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if v is None:
        return "∅"
    return f"{type(v).__name__}:{v}"


def difference(df, con, statement: str) -> str | None:
    """None when both results hold the same columns and rows, else a short description."""
    got_names = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in got_names) for r in df.collect())
    answer = con.execute(statement)
    names = [c[0] for c in answer.description]
    if sorted(names) != got_names:
        return f"columns {got_names} against {sorted(names)}"
    at = [names.index(c) for c in got_names]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in answer.fetchall())
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; {got_names}; Spark only {only_got}; SQL only {only_want}"


def main() -> int:
    from checks.oracle import ORACLES
    from foliospark.plans.queries import QUERIES
    from foliospark.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            told = difference(df, con, ORACLES[name]) if name in ORACLES else f"no SQL, {df.count()} rows"
        except Exception as problem:  # report and go on with the next query
            told = f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += told is not None and not told.startswith("no SQL")
        print(f"\n== {name}: {told or 'same'} ({time.time() - start:.1f}s)", flush=True)
    print(f"\n== {bad} of {len(names)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
