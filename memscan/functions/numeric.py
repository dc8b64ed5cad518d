"""NaN- and infinity-aware column helpers.

The scores treat NaN and +-inf as values with meaning, so every helper here
keeps them the way the score definitions require, and never lets them turn
into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FLOAT_MAX

INF = float("inf")
NAN = float("nan")


def dlit(x: float) -> Column:
    """A DOUBLE literal (never DECIMAL, see ratio arithmetic)."""
    return F.lit(float(x)).cast("double")


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != dlit(INF))


def clamp_min(c: Column, lo: float) -> Column:
    """max(c, lo) that keeps NaN (SQL greatest would not)."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(c, dlit(lo)))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi] keeping NaN."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, dlit(lo)), dlit(hi)))


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is +-inf, 0/0 and NaN/0 are NaN; no ANSI error."""
    return (F.when(b != 0, a / b)
            .when(F.isnan(a), dlit(NAN))
            .when(a > 0, dlit(INF))
            .when(a < 0, dlit(-INF))
            .otherwise(dlit(NAN)))


def safe_sqrt(c: Column) -> Column:
    """sqrt that gives NaN for negative input (and keeps NaN/inf)."""
    return F.when(c < 0, dlit(NAN)).otherwise(F.sqrt(c))


def nan_to_num(c: Column, nan: float = 0.0) -> Column:
    """NaN -> 0, +inf -> largest double, -inf -> most negative double."""
    return (F.when(F.isnan(c), dlit(nan))
            .when(c == dlit(INF), dlit(FLOAT_MAX))
            .when(c == dlit(-INF), dlit(-FLOAT_MAX))
            .otherwise(c))


def finite_or(c: Column, default: float = 0.0) -> Column:
    return F.when(is_finite(c), c).otherwise(dlit(default))


def k_of(n: Column, r: Column) -> Column:
    """int(n * r) in binary floating point: the count of smallest values."""
    return F.floor(n.cast("double") * r.cast("double")).cast("int")
