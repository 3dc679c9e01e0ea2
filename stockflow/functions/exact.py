"""Aggregates whose result does not depend on the order in which tasks finish.

Doubles are added as decimals, so a retried or rescheduled task gives the same
last digit. Spread is computed from exact sums of x and x².
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: decimals that a summand keeps; a sum has room for 30 digits before the point
SCALE = 8


def decimal(col, scale: int = SCALE) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("double").cast(f"decimal(38,{scale})")


def exact_sum(col, scale: int = SCALE) -> Column:
    return F.sum(decimal(col, scale)).cast("double")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ratio(numerator, denominator) -> Column:
    """Numerator ÷ denominator, null when the denominator is zero."""
    numerator = F.col(numerator) if isinstance(numerator, str) else numerator
    denominator = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def square(col) -> Column:
    """The square as a decimal; exact for values of up to 11 digits before the point."""
    col = (F.col(col) if isinstance(col, str) else col).cast("double")
    short = F.when(F.abs(col) < 1e11, col).cast("decimal(19,8)")
    return F.coalesce((short * short).cast(f"decimal(38,{SCALE})"), decimal(col * col))


def sample_variance(n: Column, total: Column, squares: Column) -> Column:
    """Variance over n values from their sum (under 10^22) and sum of squares, both decimal or whole; null under two values.

    Both sums are moved to the whole number next to the mean while they are still decimal, so nothing is lost where
    the values are large and lie close together.
    """
    total, squares = total.cast("decimal(30,8)"), squares.cast("decimal(38,8)")
    near = F.round(total.cast("double") / n).cast("decimal(17,0)")
    moved = (near * n.cast("decimal(20,0)")).cast("decimal(22,0)")
    left = (total - moved).cast("double")
    spread = (squares - near * (total + (total - moved))).cast("double")
    return F.when(n > 1, F.greatest(F.lit(0.0), (spread - left * left / n) / (n - 1)))
