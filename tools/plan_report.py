"""Summarize the physical plans of registered queries.

usage: python tools/plan_report.py [sf_dir] [key ...]

For each query prints the counts of shuffles, joins by strategy, windows,
Python stages, generators and the parquet scans' ReadSchema / PushedFilters,
from ``explain("formatted")`` (no job is run except the eager steps a query
builder performs itself, e.g. checkpoints).
"""

import collections
import io
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from strata.plans import queries  # noqa: E402
from strata.session import local_session  # noqa: E402

NODES = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "MapInPandas", "ArrowEvalPython",
         "BatchEvalPython", "Generate", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject")


def summarize(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    header = text.split("\n\n(")[0]
    counts = collections.Counter()
    for line in header.splitlines():
        name = line.strip().lstrip(":+-* ").split(" ")[0]
        if name in NODES:
            counts[name] += 1
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
    pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\n]*\])", text)))
    parts = [", ".join(f"{k} {v}" for k, v in sorted(counts.items()))]
    parts += [f"  scan {s}" for s in scans]
    parts += [f"  pushed {p}" for p in pushed if p != "[]"]
    return "\n".join(parts)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    keys = sys.argv[2:]
    spark = local_session(4)
    qs = queries()
    for k in keys or sorted(qs):
        try:
            print(f"## {k}\n{summarize(qs[k](spark, sf))}\n")
        except Exception as exc:  # noqa: BLE001
            print(f"## {k}\nerror: {type(exc).__name__}: {str(exc)[:200]}\n")


if __name__ == "__main__":
    main()
