"""Run registered queries against DuckDB on the same tables and report differences.

usage: python check_oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd

from depotlens.plans import QUERIES
from depotlens.session import build_session, release


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, q, folder: str, inspect=None) -> str:
    df = q.run(spark, folder)
    if inspect:
        inspect(df)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = q.oracle()
    if sql is None:
        return f"rows-only ({len(got[1])} rows)"
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"FAIL columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"FAIL rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"FAIL values {len(bad)} of {len(got[1])}: {got[0]}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return f"ok ({len(got[1])} rows{'' if got[1] else ', EMPTY'})"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-"), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = connect(folder)
    failed = 0
    for name, q in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, q, folder)
        except Exception as err:  # report and go on with the next query
            text = str(err)
            verdict = "FAIL " + type(err).__name__ + " " + (text[:700] if text else traceback.format_exc()[-500:])
        failed += verdict.startswith("FAIL")
        print(f"{name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    release(spark)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
