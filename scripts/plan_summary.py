"""Summarise the physical plans of the bench queries: shuffles (Exchange
hashpartitioning / rangepartitioning / SinglePartition), broadcasts, windows,
Python stages and scanned columns. ``python scripts/plan_summary.py [--sf DIR]``."""

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bench import HEADLINE  # noqa: E402
from rolloutlab.plans.catalog import QUERIES  # noqa: E402
from rolloutlab.session import get_spark  # noqa: E402


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobin)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", plan)) + plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython", plan)),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    spark = get_spark("local[8]", 16)
    print("| query | shuffles | single-partition | broadcasts | windows | python stages |")
    print("|---|---|---|---|---|---|")
    for name in HEADLINE:
        if name.startswith("stream_"):
            continue
        df = QUERIES[name](spark, args.sf)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['windows']} | {s['python']} |")


if __name__ == "__main__":
    main()
