"""Print a markdown table of each registered query's executed plan shape.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Counts come from the final (post-AQE) physical plan after one run.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from climatrix.plans.catalog import REGISTRY  # noqa: E402
from climatrix.session import local_session  # noqa: E402

FACT = ("lineitem", "events", "orders")


def shape(plan: str) -> dict:
    scans = {t: len(re.findall(rf"{t}\.parquet", plan)) for t in FACT}
    return {
        "fact scans": ", ".join(f"{t} {n}" for t, n in scans.items() if n) or "none (materialized)",
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "joins": ", ".join(
            sorted({m for m in re.findall(r"(BroadcastHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|ShuffledHashJoin)", plan)})
        ) or "-",
        "other": ", ".join(
            sorted({m for m in re.findall(r"(Window|Expand|MapInPandas|ObjectHashAggregate|TakeOrderedAndProject|Generate)", plan)})
        ) or "-",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    cols = ["fact scans", "shuffles", "single-partition", "broadcasts", "joins", "other"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, fn in REGISTRY.items():
        df = fn(spark, sf_dir)
        df.collect()  # runs this DataFrame's own plan, so AQE's final plan is read
        plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        plan = plan.split("== Initial Plan ==")[0]  # keep AQE's final plan only
        s = shape(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main()
