"""Rounding, clipping, proportional shares, step functions, exact means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: staff needed from this many visitors per hour upwards
STAFF_STEPS = ((0, 1), (20, 2), (50, 3), (80, 4), (120, 5), (160, 6), (200, 7))
# fixed values: demand level from this many visitors in the peak hour upwards
DEMAND_STEPS = ((50, "mittel"), (120, "hoch"))
DEMAND_BELOW = "niedrig"


def half_even(x: Column) -> Column:
    """Nearest whole number as BIGINT, ties to the even neighbour."""
    return F.bround(x.cast("double"), 0).cast("bigint")


def half_even_1(x: Column) -> Column:
    """One decimal, ties decided on the exact binary value of the double.

    0.35 is stored slightly below 7/20 and becomes 0.3.  ``10 * x`` is kept as an
    exact sum of two doubles, so the comparison with the midpoint is exact.  ``x`` is
    used several times: give it a column, not a long expression.
    """
    x = x.cast("double")
    high = x.cast("float").cast("double")
    low = (x - high) * 10.0
    down = F.floor(x * 10.0).cast("double")
    past_middle = (high * 10.0 - (down + 0.5)) + low
    return (F.when(past_middle > 0, down + 1.0)
            .when(past_middle < 0, down)
            .when(x.isNotNull(), down + F.pmod(down, F.lit(2.0)))) / 10.0


def truncate(x: Column) -> Column:
    """Whole number towards zero as BIGINT."""
    return x.cast("bigint")


def not_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def share(total: Column, weight: float, weight_sum: float) -> Column:
    """total * weight / weight_sum in DOUBLE, in this order."""
    return total.cast("double") * F.lit(float(weight)) / F.lit(float(weight_sum))


def step_value(x: Column, steps: Sequence[tuple[float, object]], below: object) -> Column:
    """Value of the last step whose lower bound is <= x; ``below`` under all of them."""
    result = None
    for bound, value in sorted(steps, key=lambda s: s[0], reverse=True):
        result = (F.when(x >= bound, F.lit(value)) if result is None
                  else result.when(x >= bound, F.lit(value)))
    return F.lit(below) if result is None else result.otherwise(F.lit(below))


def staff_for(visitors: Column, steps: Sequence[tuple[float, int]] = STAFF_STEPS) -> Column:
    return step_value(visitors, steps, 1)


def demand_level(peak: Column, steps: Sequence[tuple[float, str]] = DEMAND_STEPS,
                 below: str = DEMAND_BELOW) -> Column:
    return step_value(peak, steps, below)


def exact_sum(x: Column) -> Column:
    """Sum that does not depend on row order: added as DECIMAL, returned as DOUBLE.

    Values may have 16 digits before the point; what they have beyond 12 after it is
    rounded.
    """
    return F.sum(x.cast("decimal(28,12)")).cast("double")


def exact_mean(x: Column) -> Column:
    """NULL for no values, independent of row order."""
    return exact_sum(x) / F.nullif(F.count(x), F.lit(0)).cast("double")


def noise(n: Column) -> Column:
    """Repeatable pseudo-random fraction of ``n`` in [0, 1)."""
    return F.pmod(F.sin(n.cast("double") * 12.9898) * 43758.5453, F.lit(1.0))
