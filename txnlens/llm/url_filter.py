"""URL filters with a tree of path templates for each host.

Rules decide the urls that they fit; those decisions are the labels from which the
others learn. A path's segments, digits generalised, form a tree below its host
(LEVELS levels, the last holds the rest of the path). From the root down, a
node whose children are many and rare becomes variable: its children are one
wildcard. Every node has its labelled block and allow counts; a node whose block
share does not differ from its siblings' (two-proportion test) is merged with
them, that is, judged by its parent; any other has its own purity, smoothed by
its parent's. A template with more than REJECT is rejected.

All steps are joins and aggregations. The first aggregation, by host and
generalised path, leaves a row a template, so that a host with a third of all
pages is no heavier afterwards than its distinct templates.

Defined results: a null url or one without "://" has empty host and path and is
judged as a template of the empty host; without labels the verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LEVELS = 4
#: A node with more children than this, of which each has fewer than FEW urls on average, is variable.
CHILDREN, FEW = 20, 4
#: Weight of the parent's purity; chi-square of one degree at 5 %.
SMOOTH, DIFFERS = 4.0, 3.841
#: Templates with more labelled block than this, after smoothing, are rejected: an unlabelled host is not blocked for a small majority elsewhere.
REJECT = 0.6
#: A path ends here; no path holds this.
NONE = "?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> list[Column]:
    """The path's generalised segments by level."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/")
    own = [F.coalesce(F.get(parts, F.lit(k)), F.lit(NONE)) for k in range(LEVELS - 1)]
    rest = F.when(F.size(parts) >= LEVELS, F.array_join(F.slice(parts, LEVELS, F.greatest(F.size(parts), F.lit(LEVELS))), "/")).otherwise(F.lit(NONE))
    return [*own, rest]


def judged(df: DataFrame, id_column: str = "page_id", rules=RULES) -> DataFrame:
    """id, host, path, rule and verdict of every row."""
    parsed = df.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    level = [f"s{k}" for k in range(1, LEVELS + 1)]
    pages = parsed.select("*", rule.alias("rule"), says.alias("says"), *[c.alias(s) for s, c in zip(level, segments(F.col("path")))])
    leaves = pages.groupBy("host", *level).agg(F.count("*").alias("n"), F.count_if(F.col("says") == "block").alias("b"), F.count_if(F.col("says") == "allow").alias("a"))
    leaves = written(leaves, "leaves")  # each level reads the one before it twice

    # variable nodes become wildcards, from the root down
    for k in range(LEVELS):
        above, own = ["host", *[f"t{j + 1}" for j in range(k)]], level[k]
        children = leaves.groupBy(*above, own).agg(F.sum("n").alias("n")).groupBy(*above).agg(F.count("*").alias("kinds"), F.sum("n").alias("urls"))
        variable = children.where((F.col("kinds") > CHILDREN) & (F.col("urls") < FEW * F.col("kinds"))).select(*above, F.lit(True).alias("variable"))
        leaves = leaves.join(variable, above, "left").withColumn(f"t{k + 1}", F.when(F.col("variable"), F.when(F.col(own) == NONE, NONE).otherwise("*")).otherwise(F.col(own))).drop("variable")
        leaves = written(leaves, "leaves")
    names = ["host", *[f"t{k + 1}" for k in range(LEVELS)]]
    tree = written(leaves.groupBy(*names).agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "tree")

    # purity from the root down; siblings that do not differ share their parent's
    total = tree.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("pb"), F.coalesce(F.sum("a"), F.lit(0)).alias("pa"))
    node = total.select("pb", "pa", ((F.col("pb") + SMOOTH * 0.5) / (F.col("pb") + F.col("pa") + SMOOTH)).alias("pp"), F.lit(0).alias("root"))
    key = ["root"]
    for k in range(len(names)):
        own = names[: k + 1]
        counts = tree.groupBy(*own).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
        both = counts.withColumn("root", F.lit(0)).join(node, key) if k == 0 else counts.join(node, key)
        n, m = F.col("b") + F.col("a"), F.col("pb") + F.col("pa") - F.col("b") - F.col("a")
        pooled = F.try_divide(F.col("pb"), F.col("pb") + F.col("pa"))
        gap = F.try_divide(F.col("b"), n) - F.try_divide(F.col("pb") - F.col("b"), m)
        differs = (n > 0) & (m > 0) & (F.col("pb") > 0) & (F.col("pa") > 0) & (gap * gap >= DIFFERS * pooled * (1 - pooled) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), m)))
        purity = F.when(F.coalesce(differs, F.lit(False)),  # an only child has no siblings to differ from
                         (F.col("b") + SMOOTH * F.col("pp")) / (n + SMOOTH)).otherwise(F.col("pp"))
        node = both.select(*own, F.col("b").alias("pb"), F.col("a").alias("pa"), purity.alias("pp"))
        key = own
    verdicts = leaves.join(node.select(*names, F.when(F.col("pp") > REJECT, "block").otherwise("allow").alias("learned")), names).select("host", *level, "learned")
    out = pages.join(verdicts, ["host", *level], "left")
    return out.select(id_column, "host", "path", "rule", F.coalesce("says", "learned").alias("verdict"))


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    rule = says = "NULL"
    for own, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}'))"
        rule, says = f"CASE WHEN {fits} THEN '{own}{start}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g'), '/')"
    split = ", ".join([f"CASE WHEN len(p) >= {k + 1} THEN p[{k + 1}] ELSE '{NONE}' END AS s{k + 1}" for k in range(LEVELS - 1)]
                      + [f"CASE WHEN len(p) >= {LEVELS} THEN array_to_string(p[{LEVELS}:], '/') ELSE '{NONE}' END AS s{LEVELS}"])
    sql = f"""WITH parsed AS (
      SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{high}', '{low}'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, {rule} AS rule, {says} AS says, {parts} AS p FROM parsed),
    w0 AS (SELECT page_id, host, path, rule, says, (says = 'block')::INTEGER AS b, (says = 'allow')::INTEGER AS a, {split} FROM ruled)"""
    # every page carries its nodes; windows count them
    above = ["host"]
    for k in range(LEVELS):
        own, on = f"s{k + 1}", ", ".join(above)
        sql += f""",
    v{k} AS (SELECT *, count(DISTINCT {own}) OVER (PARTITION BY {on}) AS kinds, count(*) OVER (PARTITION BY {on}) AS urls FROM w{k}),
    w{k + 1} AS (SELECT * EXCLUDE (kinds, urls), CASE WHEN kinds > {CHILDREN} AND urls < {FEW} * kinds AND {own} <> '{NONE}' THEN '*' ELSE {own} END AS t{k + 1} FROM v{k})"""
        above.append(f"t{k + 1}")
    total = "coalesce(sum(b) OVER (), 0) AS pb, coalesce(sum(a) OVER (), 0) AS pa"
    sql += f""",
    n0 AS (SELECT *, (pb + {SMOOTH} * 0.5) / (pb + pa + {SMOOTH}) AS pp FROM (SELECT *, {total} FROM w{LEVELS}))"""
    for k in range(len(above)):
        on = ", ".join(above[: k + 1])
        sql += f""",
    c{k} AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY {on}), 0) AS nb, coalesce(sum(a) OVER (PARTITION BY {on}), 0) AS na FROM n{k}),
    j{k} AS (SELECT *, (nb + na)::DOUBLE AS n, (pb + pa - nb - na)::DOUBLE AS m FROM c{k}),
    n{k + 1} AS (SELECT * EXCLUDE (pb, pa, pp, nb, na, n, m), nb AS pb, na AS pa, CASE WHEN n > 0 AND m > 0 AND pb > 0 AND pa > 0 THEN
               CASE WHEN (nb / n - (pb - nb) / m) * (nb / n - (pb - nb) / m) >= {DIFFERS} * (pb::DOUBLE / (pb + pa)) * (1 - pb::DOUBLE / (pb + pa)) * (1 / n + 1 / m)
               THEN (nb + {SMOOTH} * pp) / (n + {SMOOTH}) ELSE pp END ELSE pp END AS pp FROM j{k})"""
    return sql + f"""
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN pp > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM n{len(above)}"""
