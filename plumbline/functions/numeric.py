"""Guards and rounding shared by every formula (survey F21, F27, P10, P12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x) -> Column:
    """A column from a name, a column, or a plain number."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def once(value: Column, body) -> Column:
    """``body`` of a costly value that must be computed once, not per mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(x) -> Column:
    """The value as a double, 0 when it is missing, NaN or infinite."""
    v = col(x).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(INF))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def to_number(text) -> Column:
    """Lenient text-to-double, 0 when the text is no number."""
    return finite(col(text).try_cast("double"))


def to_count(x) -> Column:
    """A non-negative whole number."""
    return F.greatest(F.lit(0), F.floor(finite(x) + 0.5)).cast("bigint")


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(x)))


def clamp01(x) -> Column:
    return clamp(finite(x), 0.0, 1.0)


def over_baseline(value, baseline) -> Column:
    """``value / baseline`` clamped to [0, 1]; a non-positive baseline counts as 1."""
    v, b = col(value).cast("double"), col(baseline).cast("double")
    return F.when(b <= 0, clamp01(v)).otherwise(clamp01(F.try_divide(v, b)))


def fixed(x, places: int) -> Column:
    """Round half up after dropping binary noise below 1e-9.

    Summation order differs between engines and between runs, so a mean that
    is exactly on a half must not fall either way with it.
    """
    return F.round(col(x).cast("decimal(18,9)"), places).cast("double")


def fixed_text(x, places: int) -> Column:
    """The same rounding as text with exactly ``places`` digits."""
    return F.round(col(x).cast("decimal(18,9)"), places).cast(f"decimal(18,{places})").cast("string")


def short_number(x, places: int) -> Column:
    """Rounded number as text without trailing zeros (``12.50`` -> ``12.5``)."""
    return F.regexp_replace(fixed_text(x, places), r"\.?0+$", "") if places else fixed_text(x, 0)


def micros(ts) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(col(ts).cast("timestamp"))
