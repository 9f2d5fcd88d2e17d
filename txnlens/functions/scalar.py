"""Scalar feature expressions: every helper returns a Column, so the work stays
inside whole-stage codegen (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference.
# Reference epoch of the e-commerce time offsets.
REF_EPOCH = "2017-11-30 00:00:00"
EARTH_RADIUS_KM = 6371.0
DAYS_PER_YEAR = 365.25
# Clip ranges applied before modelling.
NUMERIC_CLIP = {
    "amt_zscore": (-10.0, 10.0),
    "velocity_1h": (0.0, 200.0),
    "velocity_24h": (0.0, 1000.0),
}
# Privacy / anonymous mail domains (12) and free mail domains (22).
ANON_DOMAINS = [
    "protonmail.com", "guerrillamail.com", "yopmail.com", "dispostable.com",
    "mailnull.com", "sharklasers.com", "trashmail.com", "tempr.email", "cuvox.de",
    "anonaddy.com", "tutanota.com", "cock.li",
]
FREE_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com",
    "live.com", "icloud.com", "me.com", "msn.com", "comcast.net",
    "yahoo.fr", "yahoo.co.uk", "yahoo.de", "yahoo.es", "yahoo.co.jp",
    "hotmail.co.uk", "hotmail.fr", "hotmail.de", "att.net", "verizon.net",
    "sbcglobal.net", "frontier.com",
]
# Text values that count as missing when rendering (after lower + trim).
MISSING_TEXT = ["nan", "none", "missing", "__missing__", ""]
# The characters of the regular expression (?U)\s.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_EPOCH_NTZ = "1970-01-01 00:00:00"


def offset_to_timestamp(seconds) -> Column:
    """Reference epoch + an offset in seconds, as a wall-clock TIMESTAMP_NTZ.
    Built from whole days plus the seconds of the day, so no session time
    zone (or its daylight-saving rules) enters the arithmetic."""
    s = _c(seconds).cast("long")
    day = F.date_add(F.to_date(F.lit(REF_EPOCH[:10])), F.floor(s / 86400).cast("int"))
    sod = F.pmod(s, F.lit(86400))
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day),
                                (sod / 3600).cast("int"), (F.pmod(sod, F.lit(3600)) / 60).cast("int"),
                                F.pmod(sod, F.lit(60)).cast("decimal(8,6)"))


def epoch_seconds(ts, ntz: bool = True) -> Column:
    """Whole seconds since 1970. A wall-clock TIMESTAMP_NTZ (parquet written
    without a zone) is read as UTC whatever the session zone; an instant
    (TIMESTAMP) uses ``unix_seconds``."""
    t = _c(ts)
    if ntz:
        # From calendar fields only: Spark's timestamp arithmetic on NTZ values
        # still consults the session zone around daylight-saving changes.
        days = F.datediff(t.cast("date"), F.to_date(F.lit(_EPOCH_NTZ[:10]))).cast("long")
        return (days * 86400 + F.hour(t).cast("long") * 3600 + F.minute(t).cast("long") * 60
                + F.second(t).cast("long"))
    return F.unix_seconds(t)


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (Spark ``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(ts).cast("date"))


def age_years(ts, dob) -> Column:
    """Whole days between the event and the birth date, / 365.25."""
    return F.datediff(_c(ts).cast("date"), _c(dob).cast("date")) / F.lit(DAYS_PER_YEAR)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; ``a`` is capped at 1 so rounding never feeds
    ``asin`` a value above 1."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def email_group(domain) -> Column:
    """missing / anonymous / free / corporate (case-insensitive lookup)."""
    d = F.lower(_c(domain))
    return (F.when(_c(domain).isNull(), F.lit("missing"))
            .when(d.isin(ANON_DOMAINS), F.lit("anonymous"))
            .when(d.isin(FREE_DOMAINS), F.lit("free"))
            .otherwise(F.lit("corporate")))


def email_match(p, r) -> Column:
    """-1.0 if either side is null, else 1.0 / 0.0 on exact equality."""
    return (F.when(_c(p).isNull() | _c(r).isNull(), F.lit(-1.0))
            .when(_c(p) == _c(r), F.lit(1.0)).otherwise(F.lit(0.0)))


def clip(x, lo: float, hi: float) -> Column:
    """Clip that keeps null as null (``greatest``/``least`` skip nulls)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("double"), F.lit(lo)), F.lit(hi)))


def clip_named(name: str, x=None) -> Column:
    """Apply the fixed clip range of a feature, if it has one."""
    x = F.col(name) if x is None else _c(x)
    if name in NUMERIC_CLIP:
        lo, hi = NUMERIC_CLIP[name]
        return clip(x, lo, hi)
    return x.cast("double")


def logistic(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(logit)))


def score_bin(score, n_bins: int = 5) -> Column:
    """``numpy.digitize`` on the inner edges of ``linspace(0, 1, k + 1)``:
    the number of inner edges <= score. The edges are the exact doubles numpy
    produces (for k = 5 the third is 0.6000000000000001, so 0.6 -> bin 2)."""
    s = _c(score)
    terms = [F.when(s >= F.lit(e), 1).otherwise(0) for e in bin_edges(n_bins)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def bin_edges(n_bins: int) -> list[float]:
    """Inner edges of ``linspace(0, 1, n_bins + 1)`` as numpy computes them."""
    import numpy as np
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def cell_key(label, score, n_bins: int = 5) -> Column:
    """``"{label}|{bin}"``."""
    return F.concat_ws("|", _c(label).cast("int").cast("string"),
                       score_bin(score, n_bins).cast("string"))


def is_missing(x, dtype: str = "string") -> Column:
    """Null, NaN, or text that is one of nan/none/missing/__missing__/'' after
    lower + strip (all white space, as Python strips). ``number``: a column of a
    numeric type, whose text is none of these."""
    x = _c(x)
    cond = x.isNull()
    if dtype in ("double", "float", "number"):
        cond = cond | F.isnan(x)
    if dtype == "number":
        return cond
    return cond | F.lower(F.btrim(x.cast("string"), F.lit(WHITE_SPACE))).isin(MISSING_TEXT)
