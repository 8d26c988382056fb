"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
FORMATS = ("yyyy-MM-dd", "dd MMMM yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
#: Result digits: floats are sums in no fixed order, so results are rounded.
DIGITS = 6


def r6(c: Column | str) -> Column:
    return F.round(c, DIGITS)


def clamp(p: Column, low: float = EPS, high: float = 1 - EPS) -> Column:
    """A probability kept away from 0 and 1."""
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def dot(a: str, b: str) -> Column:
    """Inner product of two float arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine; null where a vector is zero, null or of another size."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def iso_date(c: Column | str) -> Column:
    """A date typed as text; null if it is none."""
    return F.try_to_date(c, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")


def any_date(c: Column | str) -> Column:
    """A date typed in one of FORMATS, the first that fits; null for an impossible date or another form."""
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in FORMATS))


def words(c: Column | str) -> Column:
    """Lower-case words between blanks of any kind (Unicode's separators and the control signs that count as blanks)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(col), "[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+"), lambda w: w != "")


def netloc(c: Column | str) -> Column:
    """Host with port of a URL; '' without a scheme."""
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(c: Column | str) -> Column:
    """Host in lower case, stripped of leading letters w and points (all of them, as published scores assume)."""
    return F.ltrim(F.lower(netloc(c)), F.lit("w."))


def normal_topic(t: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def normal_topics(c: Column | str) -> Column:
    """Topics trimmed, lower case, joined by underscores, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, normal_topic), lambda x: x != "")))


def brier_map_strict(probs: Column, truth: Column, fail: bool = True) -> Column:
    """Sum of squared errors over the options of an answer; one that lacks the truth is an error, or null."""
    told = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + F.pow(F.coalesce(e["value"], F.lit(0.0)) - F.when(e["key"] == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    absent = F.raise_error(F.concat(F.lit("the truth is not among the options: "), truth)).cast("double") if fail else F.lit(None).cast("double")
    return F.when(F.array_contains(F.map_keys(probs), truth), told).otherwise(absent)


def brier_map(probs: Column, truth: Column) -> Column:
    """Sum of squared errors over all options and the truth; a missing truth counts as probability 0."""
    pairs = F.map_entries(probs)
    told = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + F.pow(F.coalesce(e["value"], F.lit(0.0)) - F.when(e["key"] == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return told + F.when(F.array_contains(F.map_keys(probs), truth), 0.0).otherwise(1.0)
