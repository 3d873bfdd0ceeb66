"""Run catalogue queries beside their SQL twins on DuckDB and compare rows, columns and value types.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    kinds = {c: (spark_pdf[c].dtype, duck_pdf[c].dtype) for c in spark_pdf.columns if spark_pdf[c].dtype != duck_pdf[c].dtype}
    a, b = rows(spark_pdf), rows(duck_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    if kinds and len(a):
        return f"types {kinds}"
    return None


def main() -> int:
    from tracehound.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    d = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or n.startswith(a + "_") for a in args)]
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            got = queries[name](spark, d).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.execute(oracles[name]).df()
                note = compare(got, want)
            else:
                note = None
            state = "FAIL" if note else ("ok" if name in oracles else "rows-only")
        except Exception as ex:  # report and go on with the next query
            t1, note, state, got = time.time(), f"{type(ex).__name__}: {str(ex)[:600]}", "FAIL", []
        failed += state == "FAIL"
        print(f"{state:9s} {name:34s} {len(got):7d} rows {t1 - t0:6.2f}s duck {time.time() - t1:5.2f}s {note or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
