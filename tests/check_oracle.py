"""Command line: compare queries with their SQL.  check_oracle.py [sf] [name ...]

CHECK_CONF may hold session settings, ``key=value`` separated by semicolons.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from flowlens.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.001"
    sf_dir = f"{oracle.TESTDATA}/sf{sf}"
    conf = dict(c.split("=", 1) for c in os.environ.get("CHECK_CONF", "").split(";") if c)
    spark = local_session("check", 8, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        begin = time.perf_counter()
        try:
            df = fn(spark, sf_dir)
            columns, rows = oracle.spark_rows(df)
            seconds = time.perf_counter() - begin
            if name not in sqls:
                print(f"rows  {name:24} {len(rows):8} {seconds:6.2f}s", flush=True)
                continue
            duck = time.perf_counter()
            expected_columns, expected = oracle.duck_rows(con, sqls[name])
            duck = time.perf_counter() - duck
            types = oracle.type_differences(df, con, sqls[name])
            ok = columns == expected_columns and rows == expected and not types
            print(
                f"{'ok   ' if ok else 'DIFF '} {name:24} {len(rows):8} {len(expected):8} "
                f"{seconds:6.2f}s sql {duck:5.2f}s {types or ''}",
                flush=True,
            )
            if not ok:
                bad += 1
                print("   ", columns, expected_columns)
                pairs = [(a, b) for a, b in zip(rows, expected) if a != b]
                for a, b in pairs[:3]:
                    print("   spark", a, "\n   sql  ", b)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
