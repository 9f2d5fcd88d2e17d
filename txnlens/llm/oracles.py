"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import pii, runs, url_filter
from .chat import CONTROLS, FRAMES
from .prefix_trie import FAMILY, MOST_SHARED
from .secret_scan import BASE, EXTRA

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def chat(own: str) -> str:
    """``own``: the text that the two added turns say."""
    controls = "|".join("".join(f"[{c}]" if c.isalpha() else f"\\{c}" for c in x) for x in (*sorted(CONTROLS, key=len, reverse=True), "\\"))
    more = lambda c: f"len(regexp_extract_all({c}, '{controls}'))"  # noqa: E731  an escape adds one character
    frame = " ".join(f"WHEN '{r}' THEN {len(CONTROLS[a]) + len(CONTROLS[b])}" for r, (a, b) in FRAMES.items())
    other = len("[ROLE]") + len("[/ROLE]") + len("</s>")
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{own}'), (-1, 1, 'assistant', '{own}')),
x AS (SELECT *, length(text) + {more('text')} + CASE role {frame} ELSE {other} + length(role) + {more('role')} END AS chars,
             CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' {order})) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id"""


def top_k(k: int, scale: int, step: int) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {step} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""


def secrets() -> str:
    """Spans from the pieces between a rule's matches: a match starts behind all the
    pieces and matches before it."""
    parts = []
    for order, rule in enumerate(BASE + EXTRA):
        pattern = rule.pattern.replace("\\x20", " ").replace("[\\\"']", "[\"'']").replace("[\"']", "[\"'']")
        if rule.tail:
            pattern = pattern.removesuffix(f"[{rule.tail}]+") + f"([{rule.tail}]+)"
        parts.append(f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS m,
       regexp_extract_all(text, '{pattern}', {1 if rule.tail else 0}) AS g, string_split_regex(text, '{pattern}') AS p, {rule.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f),
s AS (SELECT doc_id, o, kind, k, m, g, least,
             CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM u),
t AS (SELECT doc_id, o, a, kind || ':' || a || ':' || (a + length(m[k])) AS span FROM s WHERE length(g[k]) >= least)
SELECT doc_id, count(t.o) FILTER (WHERE o = 0) AS n_assign, count(t.o) FILTER (WHERE o = 1) AS n_access, count(t.o) FILTER (WHERE o = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, o) FILTER (WHERE o < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, o), '') AS spans
FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id"""


def decontam(window: int, one_in: int) -> str:
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, {words('text', pattern)} AS w FROM documents),
i AS (SELECT item_id, {words('text', pattern)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS x
       FROM (SELECT *, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, k, item_id FROM dw JOIN iw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, n, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(coalesce(CAST(item_id AS VARCHAR), ''), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {one_in} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def near_dup(shingle: int, percent: int) -> str:
    pattern = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words('text', pattern)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + {shingle - 1}], 'string_agg', ' ') AS x
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""


def personal_data() -> str:
    """As for secrets, a span's place is the length of all before it; then each kind's
    check and the words around the span."""
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = lambda d: (f"list_sum(list_transform(range(length({d})), lambda k: list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], CAST(substr({d}, length({d}) - k, 1) AS INTEGER) + 1) * (k % 2) "  # noqa: E731
                      f"+ CAST(substr({d}, length({d}) - k, 1) AS INTEGER) * (1 - k % 2))) % 10 = 0")
    # one character after the other; a letter counts for two digits
    mod97 = lambda v: (f"list_reduce(list_prepend(0, list_transform(range(1, length({v}) + 1), lambda k: position(substr({v}[5:] || {v}[:4], k, 1) IN '0123456789{UPPER}') - 1)), "  # noqa: E731
                       f"lambda acc, c: (acc * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1")
    near = lambda at, which: f"substr(text, {at}, 1) {which}"
    alnum = "SIMILAR TO '[A-Za-z0-9]'"
    lone = f"NOT coalesce(a > 0 AND {near('a', alnum)}, false) AND NOT {near('b + 1', alnum)}"
    account = "replace(x, ' ', '')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(x, '.'), lambda v: length(ltrim(v, '0')) > 3 OR coalesce(try_cast(ltrim(v, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn(digits)}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({account}) BETWEEN 15 AND 34 AND {lone} AND {mod97(account)}",
        "ssn": f"x[1:3] NOT IN ('000', '666') AND x[1:3] < '900' AND x[5:6] <> '00' AND x[8:] <> '0000' AND {lone} "
               f"AND NOT coalesce(a > 0 AND {near('a', chr(61))} '-', false) AND {near('b + 1', '<>')} '-'",
        "local_phone": f"{lone} AND NOT contains(substr(text, greatest(a - 6, 0) + 1, least(a, 6)), '+')",
        "card_part": f"length(x) BETWEEN 13 AND 19 AND {luhn('x')} AND (coalesce(a > 1 AND substr(text, a - 1, 2) SIMILAR TO '[0-9][ -]', false) "
                     "OR substr(text, b + 1, 2) SIMILAR TO '[ -][0-9]')",
    }
    found = " UNION ALL ".join(
        f"""SELECT doc_id, row, text, {order} AS o, '{kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS p FROM d"""
        for order, kind in enumerate(pii.KINDS) for pattern in [pii.PATTERNS[kind].replace("\\x20", " ")])
    check = " ".join(f"WHEN {order} THEN {checks[kind]}" for order, kind in enumerate(pii.KINDS))
    own = " ".join(f"WHEN {order} THEN {k.score}" for order, k in enumerate(pii.KINDS.values()))
    words = " ".join(f"WHEN {order} THEN '{pii.context_pattern(k.words)}'" for order, k in enumerate(pii.KINDS.values()))
    counts = ", ".join(f"count(o) FILTER (WHERE o = {order}) AS n_{kind}" for order, kind in enumerate(pii.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
f AS ({found}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f),
s AS (SELECT doc_id, row, text, o, kind, m[k] AS x,
             CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM u),
e AS (SELECT *, a + length(x) AS b FROM s),
g AS (SELECT *, translate(substr(text, greatest(a - {pii.BEFORE}, 0) + 1, least(a, {pii.BEFORE})), '{UPPER}', '{LOWER}') AS before,
             translate(substr(text, b + 1, {pii.AFTER}), '{UPPER}', '{LOWER}') AS after, CASE o {words} END AS words FROM e WHERE CASE o {check} END),
t AS (SELECT doc_id, row, o, a, kind || ':' || a || ':' || b AS span,
             least(greatest(CASE o {own} END + CASE WHEN regexp_matches(before, words) OR regexp_matches(after, words) THEN {pii.GAIN} ELSE 0 END
                            - CASE WHEN regexp_matches(before, '{pii.context_pattern(pii.OTHERS)}') THEN {pii.LOSS} ELSE 0 END, 0), 100) AS score FROM g),
v AS (SELECT * FROM t WHERE o < {len(pii.BASE)} OR score >= {pii.LEAST})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' ORDER BY a, o) FILTER (WHERE o < {len(pii.BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, o), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, o), '') AS scores
FROM d LEFT JOIN v USING (row) GROUP BY d.row, d.doc_id"""


def crc32(column: str) -> str:
    """The checksum of a column's decimal text, bit by bit."""
    bits = (f"flatten(list_transform(range(1, length(CAST({column} AS VARCHAR)) + 1), lambda k: list_transform(range(8), "
            f"lambda b: CAST((ascii(substr(CAST({column} AS VARCHAR), CAST(k AS INTEGER), 1)) >> CAST(b AS INTEGER)) & 1 AS BIGINT))))")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"


def periodic_runs(least_words: int, least_periods: int) -> str:
    """Equal words q apart, for every q, are in stretches; a stretch that several q
    share is a run of the smallest."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32('doc_id')} END AS h FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
w AS (SELECT row, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS word FROM p),
e AS (SELECT x.row, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND {least_periods} * (y.i - x.i) <= x.n),
f AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS stretch FROM e),
r AS (SELECT row, start, length, min(q) AS period
      FROM (SELECT row, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY row, q, stretch HAVING count(*) + q >= greatest({least_words}, {least_periods} * q))
      GROUP BY row, start, length),
t AS (SELECT row, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS b,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY row),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept
      FROM (SELECT row, i, word FROM w EXCEPT ALL SELECT DISTINCT w.row, i, word FROM w JOIN r ON w.row = r.row AND i >= start + period AND i < start + length) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -b.start AS start, b.length AS length, -b.period AS period, 1000 * b.length // -b.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (row) LEFT JOIN k USING (row)"""


def prefix_trie(family: int, most: int) -> str:
    """A prefix is the list of its turns; a node's subtree is found by the smallest
    members of the nodes in it."""
    return f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, {crc32('conv_id')} % {most + 1} AS h, conv_id - conv_id % {family} AS base FROM c),
b AS (SELECT i.conv_id, 0 AS kind, r, role, text FROM i JOIN c ON c.conv_id = base AND r < h
      UNION ALL SELECT conv_id, 1, r, role, text FROM i JOIN c USING (conv_id) WHERE r >= h),
l AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY kind, r) FILTER (WHERE r IS NOT NULL), []) AS turns FROM i LEFT JOIN b USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM l),
q AS (SELECT conv_id, depth, turns[1:depth] AS own, turns[1:depth - 1] AS parent, len(turns) = depth AS ends FROM p),
n AS (SELECT depth, own, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY depth, own),
v AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(own[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS value FROM n),
k AS (SELECT depth - 1 AS depth, parent AS own, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (depth, own)),
u AS (SELECT q.depth, q.own, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(value) AS BIGINT) AS saved_tokens
      FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.depth, q.own)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN u ON u.depth = m.depth AND u.own = m.own LEFT JOIN m o ON m.depth > 0 AND o.depth = m.depth - 1 AND o.own = m.parent"""


def all_oracles(control_text: str, k: int, scale: int, step: int, window: int, one_in: int, shingle: int, percent: int) -> dict[str, str]:
    return {"op2_chat": chat(control_text), "op3_topk": top_k(k, scale, step), "op5_secrets": secrets(), "op6_decontam": decontam(window, one_in),
            "op7_urls": url_filter.oracle(), "op8_near_dup": near_dup(shingle, percent), "op11_pii": personal_data(),
            "op12_runs": periodic_runs(runs.LEAST_WORDS, runs.LEAST_PERIODS), "op13_prefix_trie": prefix_trie(FAMILY, MOST_SHARED)}
