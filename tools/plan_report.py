"""Digest of the physical plans of the headline queries (PLANS.md).

For each query: scans with their ReadSchema and pushed filters, the number of
shuffles (Exchange), broadcasts, joins by strategy, windows, Python stages and
whole-stage-codegen spans, taken from ``explain("formatted")`` at sf0.01.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def digest(df) -> list[str]:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    count = lambda pat: len(re.findall(pat, text, re.M))
    lines = [f"- shuffles (Exchange): {count(r'^\(\d+\) Exchange')} (reused: {count(r'^\(\d+\) ReusedExchange')}), "
             f"broadcasts: {count(r'^\(\d+\) BroadcastExchange')}, "
             f"windows: {count(r'^\(\d+\) Window')}, "
             f"codegen stages: {len(set(re.findall(r'\[codegen id : (\d+)\]', text)))}",
             f"- joins: BroadcastHashJoin {count(r'^\(\d+\) BroadcastHashJoin')}, SortMergeJoin "
             f"{count(r'^\(\d+\) SortMergeJoin')}, ShuffledHashJoin {count(r'^\(\d+\) ShuffledHashJoin')}, "
             f"nested loop {count(r'^\(\d+\) BroadcastNestedLoopJoin')}, cartesian {count(r'^\(\d+\) CartesianProduct')}",
             f"- Python stages: {count(r'^\(\d+\) (?:ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)')}"]
    seen = {}
    for m in re.finditer(r"\(\d+\) Scan (\w+).*?\n((?:[A-Z][^\n]*\n)+)", text):
        body = m.group(2)
        loc = re.search(r"Location: \w+ \[?(?:file:)?([^\]\n]*)", body)
        rs = re.search(r"ReadSchema: ([^\n]*)", body)
        pf = re.search(r"PushedFilters: ([^\n]*)", body)
        name = os.path.basename(loc.group(1).split(",")[0]) if loc else m.group(1)
        k = f"`{name}`: ReadSchema `{rs.group(1) if rs else '-'}`, PushedFilters `{pf.group(1) if pf else '-'}`"
        seen[k] = seen.get(k, 0) + 1
    lines += [f"- scan {k} (x{n} in plan)" for k, n in seen.items()]
    return lines


def main():
    import bench
    from tessera.plans.catalog import QUERIES, load_all
    from tessera.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    load_all()
    out = ["# PLANS", "", f"Physical-plan digest of the headline queries (`tools/plan_report.py`, {os.path.basename(sf)}). "
           "The first lines describe the initial plan from `explain(\"formatted\")`; with AQE on, codegen stages, "
           "exchange reuse and runtime broadcasts only exist in the final adaptive plan, summarised last "
           "(after running the query).", ""]
    for name in bench.HEADLINE:
        out.append(f"## {name}")
        df = QUERIES[name](spark, sf)
        out += digest(df)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        stages = {m for m in re.findall(r"\*\((\d+)\)", final)}
        out.append(f"- final adaptive plan: {len(stages)} whole-stage-codegen stages, "
                   f"{final.count('ReusedExchange')} reused exchanges, "
                   f"{final.count('BroadcastHashJoin')} broadcast hash joins, {final.count('SortMergeJoin')} sort-merge joins")
        out.append("")
    print("\n".join(out))


if __name__ == "__main__":
    main()
