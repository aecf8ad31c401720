"""Print the final (post-AQE) physical plan tree of registered queries.

    python tools/explain.py [sf_dir] [name ...]

Each query is executed once (``collect``) so AQE's runtime decisions
(broadcast conversions, coalesced partitions, reused stages) are visible.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
from tarmac.plans.catalog import queries  # noqa: E402
from tarmac.session import build_session  # noqa: E402

HEADLINE = ["daily_ranking", "delay_by_ssr_group", "bags_per_pax", "hard_destinations_majority"]


def final_tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    keep = []
    for line in plan.splitlines():
        line = line.rstrip()
        if not line.strip():
            continue
        # drop long attribute lists, keep the operator and its key arguments
        keep.append(line if len(line) < 170 else line[:167] + "...")
    return "\n".join(keep)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or HEADLINE
    spark = build_session("local[8]")
    for name in names:
        df = queries()[name](spark, sf_dir)
        df.collect()
        print(f"### {name}\n\n```\n{final_tree(df)}\n```\n")


if __name__ == "__main__":
    main()
