"""Vector math on ``ARRAY<FLOAT|DOUBLE>`` columns with JVM higher-order
functions (``transform`` / ``zip_with`` / ``aggregate``): no Python per row.

Four normalisation conventions exist and are kept apart:

* stored copy: ``x / max(|x|, 1e-8)``            -> :func:`unit_stored`
* metric: ``x / (|x| + 1e-8) * scale``           -> :func:`normalize_to`
* cosine: ``x.y / max(|x| |y|, 1e-8)``            -> :func:`cosine`
* geometry: ``x / (|x| + 1e-12)``                 -> :func:`unit_geometry`
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference.
STORE_EPS = 1e-8
METRIC_EPS = 1e-8
COSINE_EPS = 1e-8
GEOMETRY_EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn``. A row-level value
    referenced inside a ``transform`` lambda would otherwise be recomputed for
    every element (O(d^2) for a norm)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def vec_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def vec_dot(a, b) -> Column:
    return vec_sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def vec_norm(v) -> Column:
    return F.sqrt(vec_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def vec_scale(v, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(v), lambda x: x.cast("double") * s)


def vec_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def vec_sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def metric_scale(v) -> Column:
    """``sqrt(d)`` from the array size, so ``mse_nrm = 2 (1 - cos)``."""
    return F.sqrt(F.size(_c(v)).cast("double"))


def normalize_to(v, scale=None, eps: float = METRIC_EPS) -> Column:
    scale = metric_scale(v) if scale is None else (
        scale if isinstance(scale, Column) else F.lit(float(scale)))
    return let(vec_norm(v) + F.lit(eps),
               lambda n: F.transform(_c(v), lambda x: x.cast("double") / n * scale))


def unit_stored(v) -> Column:
    return let(F.greatest(vec_norm(v), F.lit(STORE_EPS)),
               lambda n: F.transform(_c(v), lambda x: x.cast("double") / n))


def unit_geometry(v) -> Column:
    return let(vec_norm(v) + F.lit(GEOMETRY_EPS),
               lambda n: F.transform(_c(v), lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    return vec_dot(a, b) / F.greatest(vec_norm(a) * vec_norm(b), F.lit(COSINE_EPS))


def row_mse_nrm(pred, gold) -> Column:
    """Per-row mean squared difference of the metric-normalised vectors."""
    d = F.zip_with(normalize_to(pred, metric_scale(gold)), normalize_to(gold),
                   lambda x, y: (x - y) * (x - y))
    return vec_sum(d) / F.size(_c(gold)).cast("double")


def completion_mask(ids, eos: int) -> Column:
    """1 up to and including the first EOS, 0 after; all 1 without an EOS."""
    return let(F.array_position(_c(ids), F.lit(eos)),
               lambda pos: F.transform(_c(ids), lambda x, i: F.when((pos == 0) | (i < pos), 1)
                                       .otherwise(0)))


def masked_mean(x, mask) -> Column:
    """``sum(x * m) / max(1, sum(m))`` per row."""
    num = vec_sum(F.zip_with(_c(x), _c(mask), lambda a, m: a.cast("double") * m.cast("double")))
    den = F.aggregate(_c(mask), F.lit(0.0), lambda acc, m: acc + m.cast("double"))
    return num / F.greatest(F.lit(1.0), den)


def kl_k3(logp_policy, logp_ref) -> Column:
    """Per-token ``exp(d) - d - 1`` with ``d = ref - policy``."""
    return F.zip_with(_c(logp_policy), _c(logp_ref),
                      lambda p, r: F.exp(r - p) - (r - p) - F.lit(1.0))
