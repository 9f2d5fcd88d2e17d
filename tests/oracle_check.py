"""Run registered queries next to their DuckDB oracles and compare row count,
column names, column types and an order-insensitive hash of the exact values
(the queries round doubles to 6 places themselves where the two engines'
arithmetic differs).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        # exact: both sides round where values come from different
        # arithmetic, so the doubles must agree bit for bit
        return repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


_FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
           "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
           "array<double>": "DOUBLE[]", "array<float>": "FLOAT[]", "array<bigint>": "BIGINT[]",
           "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]"}


def type_mismatches(df, con, sql: str) -> list:
    spark_t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    duck_t = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [(c, t, duck_t.get(c)) for c, t in spark_t.items()
            if _FAMILY.get(t, t.upper()) != duck_t.get(c)]


def check(spark, con, sf_dir: str, name: str, qfn, sql: str | None) -> dict:
    t0 = time.time()
    df = qfn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "rows": len(s_rows), "spark_s": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return out
    bad_types = type_mismatches(df, con, sql)
    if bad_types:
        out["status"] = f"TYPES {bad_types}"
        return out
    ns, hs = digest(s_cols, s_rows)
    nd, hd = digest(d_cols, d_rows)
    if ns != nd:
        out["status"] = f"ROWCOUNT {ns} vs {nd}"
    elif hs != hd:
        out["status"] = "VALUES"
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["diff"] = diff
        out["cols"] = sorted(s_cols)
    else:
        out["status"] = "OK"
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from txnlens import get_spark
    extra = {"spark.sql.session.timeZone": os.environ["CHECK_TZ"]} if os.environ.get("CHECK_TZ") else None
    spark = get_spark("local[8]", shuffle_partitions=8, extra=extra)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = check(spark, con, sf_dir, name, qs[name], ors.get(name))
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
