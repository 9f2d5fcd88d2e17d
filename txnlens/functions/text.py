"""Text helpers as Column expressions (explanation tags, token Jaccard, cache
keys, bullet validity)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference.
OPEN_TAG = "<explanation>"
CLOSE_TAG = "</explanation>"
BULLET_CHARS = ["-", "•", "*"]

# Unicode-aware whitespace, as Python's str.strip() / str.split() use.
_WS = "(?U)\\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    return F.regexp_replace(_c(x), f"^{_WS}+|{_WS}+$", "")


def wrap_explanation(summary) -> Column:
    s = strip_ws(summary)
    return F.when(s.startswith(OPEN_TAG), s).otherwise(
        F.concat(F.lit(OPEN_TAG + "\n"), s, F.lit("\n" + CLOSE_TAG)))


def parse_explanation(text) -> Column:
    """First complete tag pair (inner whitespace trimmed, dot matches newline);
    else the text after the open tag; else the trimmed text."""
    t = _c(text)
    pair = "(?s)<explanation>(?U)\\s*(.*?)\\s*</explanation>"
    after_open = F.element_at(F.split(t, OPEN_TAG, 2), 2)
    return (F.when(t.rlike(pair), F.regexp_extract(t, pair, 1))
            .when(F.instr(t, OPEN_TAG) > 0, strip_ws(after_open))
            .otherwise(strip_ws(t)))


def has_close_tag(text) -> Column:
    return F.instr(_c(text), CLOSE_TAG) > 0


def token_set(text) -> Column:
    """Distinct whitespace-separated tokens."""
    toks = F.split(strip_ws(text), f"{_WS}+")
    return F.array_distinct(F.array_remove(toks, ""))


def token_jaccard(a, b) -> Column:
    """Token-set Jaccard: both empty -> 1, one empty -> 0."""
    ta, tb = token_set(a), token_set(b)
    na, nb = F.size(ta), F.size(tb)
    inter = F.size(F.array_intersect(ta, tb)).cast("double")
    union = F.size(F.array_union(ta, tb)).cast("double")
    return (F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(inter / union))


def cache_key(row_idx, model) -> Column:
    """First 16 hex characters of md5("{row_idx}:{model}")."""
    m = model if isinstance(model, Column) else F.lit(model)
    return F.substring(F.md5(F.concat_ws(":", _c(row_idx).cast("string"), m)), 1, 16)


def starts_with_bullet(text) -> Column:
    """Valid when the stripped text is empty or starts with - / bullet / *."""
    s = strip_ws(text)
    return (F.length(s) == 0) | F.substring(s, 1, 1).isin(BULLET_CHARS)
