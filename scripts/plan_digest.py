"""Summarise the physical plans of the headline queries.

    python scripts/plan_digest.py [--sf /root/testdata/sf0.01] > PLANS.md

For each query it lists the scans (read schema, pushed filters), join
strategies, exchanges, window operators and subqueries from
``explain("formatted")``, so plan regressions show up in review.
"""

from __future__ import annotations

import argparse
import collections
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from orderflow.plans.registry import QUERIES  # noqa: E402
from orderflow.session import build_session  # noqa: E402

OPERATORS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
             "CartesianProduct", "Exchange", "BroadcastExchange", "HashAggregate", "SortAggregate",
             "ObjectHashAggregate", "Window", "WindowGroupLimit", "Generate", "Expand", "TakeOrderedAndProject")


def digest(text: str) -> list[str]:
    ops = collections.Counter()
    for line in text.splitlines():
        m = re.match(r"^\((\d+)\) (\w+)", line)
        if m and m.group(2) in OPERATORS:
            ops[m.group(2)] += 1
    scans = []
    current = None
    for line in text.splitlines():
        if re.match(r"^\(\d+\) Scan parquet", line):
            current = {"schema": "", "pushed": ""}
            scans.append(current)
        elif current is not None and line.startswith("ReadSchema:"):
            current["schema"] = line.split(":", 1)[1].strip()
        elif current is not None and line.startswith("PushedFilters:"):
            current["pushed"] = line.split(":", 1)[1].strip()
    subqueries = len(re.findall(r"^Subquery:\d+", text, re.M))
    out = ["operators: " + ", ".join(f"{k} x{v}" for k, v in sorted(ops.items()))]
    seen = set()
    for s in scans:
        key = (s["schema"], s["pushed"])
        if key in seen:
            continue
        seen.add(key)
        out.append(f"scan: {s['schema']}" + (f"  pushed: {s['pushed']}" if s["pushed"] and s["pushed"] != "[]" else ""))
    out.append(f"scalar subqueries: {subqueries}")
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    spark = build_session("local[4]", 8)
    print("# Physical plan digest (headline queries)\n")
    print("Generated by `scripts/plan_digest.py` from `explain(\"formatted\")` at "
          f"`{os.path.basename(a.sf.rstrip('/'))}`. Counts include subquery plans.\n")
    for name in HEADLINE:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[name](spark, a.sf).explain("formatted")
        print(f"## {name}\n")
        for line in digest(buf.getvalue()):
            print(f"- {line}")
        print()


if __name__ == "__main__":
    main()
