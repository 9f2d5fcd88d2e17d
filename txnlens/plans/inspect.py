"""Plan checks: what the scale rules look like in an executed plan.

Helpers run the query (so AQE's final plan exists) and read the physical
plan text of that same execution.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def final_plan(df: DataFrame, run: bool = True) -> str:
    """The executed (AQE final) physical plan of ``df``."""
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def exchanges(plan: str) -> dict[str, int]:
    """Counts of shuffle kinds in a plan text."""
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange", plan)),
        "reused": len(re.findall(r"ReusedExchange", plan)),
    }


def scans(plan: str) -> list[dict]:
    """Per parquet scan: the columns read and the filters pushed to it."""
    out = []
    for line in plan.splitlines():
        if "FileScan parquet" not in line:
            continue
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        out.append({"read_schema": schema.group(1) if schema else None,
                    "pushed_filters": pushed.group(1) if pushed else ""})
    return out


def summary(df: DataFrame) -> dict:
    plan = final_plan(df)
    return {"exchanges": exchanges(plan), "scans": scans(plan)}
