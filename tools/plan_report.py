"""Summarise the physical plan of registered queries: exchanges, join strategies, Python
nodes, group-limited windows and the columns each parquet scan reads.

Each query is executed first, so the report shows the final adaptive plan (reused
exchanges, runtime broadcast conversions) rather than the initial one.

usage: python tools/plan_report.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans import registry  # noqa: E402
from quire.session import build_session  # noqa: E402

KINDS = [
    ("Exchange hashpartitioning", "hash exchange"),
    ("Exchange rangepartitioning", "range exchange"),
    ("Exchange SinglePartition", "single-partition exchange"),
    ("BroadcastExchange", "broadcast"),
    ("BroadcastHashJoin", "broadcast hash join"),
    ("SortMergeJoin", "sort-merge join"),
    ("ShuffledHashJoin", "shuffled hash join"),
    ("BroadcastNestedLoopJoin", "nested-loop join"),
    ("CartesianProduct", "cartesian product"),
    ("FlatMapCoGroupsInPandas", "cogroup (pandas)"),
    ("MapInPandas", "mapInPandas"),
    ("ArrowEvalPython", "pandas UDF"),
    ("WindowGroupLimit", "window group limit"),
    ("TakeOrderedAndProject", "top-k"),
    ("ReusedExchange", "reused exchange"),
    ("HashAggregate", "hash aggregate"),
    ("SortAggregate", "sort aggregate"),
    ("ObjectHashAggregate", "object hash aggregate"),
]


def _text_column(line: str) -> int:
    return len(line) - len(line.lstrip(" |:+-"))


def final_only(plan: str) -> str:
    """Drop the '== Initial Plan ==' sections of every adaptive node."""
    out, skip_from = [], None
    for line in plan.split("\n"):
        col = _text_column(line)
        if skip_from is not None:
            if col >= skip_from and line.strip():
                continue
            skip_from = None
        if "== Initial Plan ==" in line:
            skip_from = col
            continue
        out.append(line)
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16)
    registry.load_all()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{os.path.basename(sf_dir)}` (local[8]); counts are operator")
    print("occurrences in the final adaptive plan of one execution (subquery plans included).\n")
    print("| Query | Operators | Scans (columns read) |")
    print("|---|---|---|")
    for name in sorted(registry.QUERIES):
        if name in ("watch_corpus", "incremental_index", "read_documents_json", "bm25_index_write", "bm25_index_read",
                    "bm25_search_indexed", "vector_index_write", "vector_index_read", "cache_append", "apply_edit_batch", "ann_topk"):
            continue  # these execute writes or training while being built; see their docstrings
        df = registry.QUERIES[name](spark, sf_dir)
        df.collect()
        plan = final_only(df._jdf.queryExecution().executedPlan().toString())
        ops = []
        for needle, label in KINDS:
            n = plan.count(needle)
            if n:
                ops.append(f"{label} ×{n}")
        scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: InMemoryFileIndex\(\d+ paths\)\[[^\]]*/([a-z_]+)\.parquet", plan)))
        scan_txt = "; ".join(f"{t}: {cols}" for cols, t in ((re.sub(r"#\d+L?", "", c), t) for c, t in scans))
        print(f"| `{name}` | {', '.join(ops) or 'narrow projection only'} | {scan_txt} |")


if __name__ == "__main__":
    main()
