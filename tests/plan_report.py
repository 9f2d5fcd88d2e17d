"""Write PLANS.md: for every registered query, the shuffles of its executed
plan and what each parquet scan reads.

    python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from txnlens import get_spark
    from txnlens.plans import inspect as PI
    spark = get_spark("local[8]", shuffle_partitions=8)
    lines = ["# PLANS", "",
             f"Executed (AQE final) plans of the registered queries at `{sf_dir}`, generated by",
             "`tests/plan_report.py`. Columns: shuffles by kind (hash / range /",
             "single-partition), broadcasts, exchanges reused inside the plan, and per parquet",
             "scan the columns read and filters pushed into it. `jobs before` counts the Spark",
             "jobs that a query runs before its final plan (size checks, boundary keys,",
             "checkpoints, fitted parameters, streams); they are not part of this plan.", "",
             "| query | jobs before | hash | range | single | broadcast | reused | scans (columns read; pushed filters) |",
             "|---|---|---|---|---|---|---|---|"]
    sc = spark.sparkContext
    for name, fn in E.queries().items():
        sc.setJobGroup(name, name)
        df = fn(spark, sf_dir)
        before = len(sc.statusTracker().getJobIdsForGroup(name))
        s = PI.summary(df)
        x = s["exchanges"]
        scans = "<br>".join(
            f"{(v['read_schema'] or '').replace('struct<', '').rstrip('>')}"
            + (f"; {v['pushed_filters']}" if v["pushed_filters"] else "") for v in s["scans"])
        lines.append(f"| `{name}` | {before} | {x['hash']} | {x['range']} | {x['single']} | {x['broadcast']} | "
                     f"{x['reused']} | {scans.replace('|', '/')} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv)
