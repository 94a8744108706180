"""Numeric column rules: NaN and infinities are NULL, bad text is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def coerce(c) -> Column:
    """Text or number to a finite double; anything else is NULL."""
    return finite(col(c).try_cast("double"))


def unit_fallback(per_km, per_m) -> Column:
    return F.coalesce(col(per_km), col(per_m) * 1000.0)


def log1p_clipped(c) -> Column:
    """``log1p`` of the value floored at zero; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def clip(c, lo=None, hi=None) -> Column:
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def zero_as_missing(c, tolerance: float = 1e-8) -> Column:
    c = finite(c)
    return F.when(F.abs(c) > tolerance, c)


def pick(key, mapping: dict, default=None) -> Column:
    """Lookup in a small parameter table by key, as one CASE expression."""
    key = col(key)
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def linear_transform(variable, value, scales: dict[str, tuple[float, float]]) -> Column:
    """``(value + shift) * factor`` per variable name; unlisted names keep their value."""
    value = col(value)
    factor = F.coalesce(pick(variable, {k: f for k, (_, f) in scales.items()}), F.lit(1.0))
    shift = F.coalesce(pick(variable, {k: s for k, (s, _) in scales.items()}), F.lit(0.0))
    return (value + shift) * factor
