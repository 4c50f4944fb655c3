"""Wilson score interval as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortgate.fixed_values import Z95


def five_places(x: Column) -> Column:
    return F.bround(x, 5)


def frequency(alt: Column, n: Column) -> Column:
    return F.try_divide(alt.cast("double"), n.cast("double"))


def wilson_bounds(alt: Column, n: Column) -> tuple[Column, Column]:
    """Unrounded lower and upper 95% bounds, clamped to [0, 1]; null when n is 0."""
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = alt.cast("double") / size
    scale = F.lit(1.0) + F.lit(Z95 * Z95) / size
    middle = (p + F.lit(Z95 * Z95) / (size * 2)) / scale
    reach = (F.lit(Z95) / scale) * F.sqrt(
        p * (F.lit(1.0) - p) / size + F.lit(Z95 * Z95) / (size * size * 4)
    )
    return F.greatest(F.lit(0.0), middle - reach), F.least(F.lit(1.0), middle + reach)
