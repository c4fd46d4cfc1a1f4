"""Run every registered query against its DuckDB twin and print a summary.

Usage: python tests/run_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from climatrix.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                problems = [] if df.count() >= 0 else ["no rows"]
                problems = problems or []
        except Exception as e:  # noqa: BLE001
            problems = [f"error: {type(e).__name__}: {str(e)[:400]}"]
        status = "ok" if not problems else "FAIL"
        bad += bool(problems)
        tag = "" if name in sqls else " (rows only)"
        print(f"{status:4} {name}{tag} {time.time() - t0:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{len(qs) - bad}/{len(qs)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
