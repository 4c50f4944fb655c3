"""Rounding, suppression and release tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rounded(n: Column, base) -> Column:
    """Nearest multiple of ``base``, ties to even; base 0 leaves the count alone."""
    step = _column(base)
    multiple = (F.bround(n / F.nullif(step, F.lit(0))) * step).cast("long")
    return F.when(step == 0, n.cast("long")).otherwise(multiple)


def below_minimum(n: Column, min_cell, base) -> Column:
    """The raw or the rounded count is under the minimum. Zero is under it too."""
    floor = _column(min_cell)
    return (n < floor) | (rounded(n, base) < floor)


def small_cell(n: Column, min_cell, base) -> Column:
    """A non-zero cell that may not be shown."""
    return (n > 0) & below_minimum(n, min_cell, base)


def total_token(n: Column, min_cell, base) -> Column:
    """``<m`` when suppressed, else ``~rounded``."""
    hidden = F.concat(F.lit("<"), _column(min_cell).cast("string"))
    shown = F.concat(F.lit("~"), rounded(n, base).cast("string"))
    return F.when(below_minimum(n, min_cell, base), hidden).otherwise(shown)


def released_count(token: Column, min_cell) -> Column:
    """The number inside ``~N`` when it is at or above the minimum, else null."""
    n = F.when(token.startswith("~"), F.substring(token, 2, 30)).try_cast("long")
    return F.when(n >= _column(min_cell), n)


def scaled_token(token: Column, rate: float, min_cell, base) -> Column:
    """A planning estimate from a released token, suppressed again when it gets small."""
    estimate = rounded(F.bround(released_count(token, min_cell) * F.lit(rate)), base)
    hidden = F.concat(F.lit("<"), _column(min_cell).cast("string"))
    return F.when(
        estimate >= _column(min_cell), F.concat(F.lit("~"), estimate.cast("string"))
    ).otherwise(hidden)
