"""Statistics from exact integer sums, shared by windows, frozen state and streams.

Amounts are counted in thousandths and day values in seconds. Integer sums do not depend
on the order in which partitions are combined, so splitting a hot key, merging state and
retrying a task all give the same bits, and equal amounts have a variance of exactly zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_UNITS = 1000
DAY_UNITS = 86_400
WIDE = "decimal(38,0)"


def units(value: Column, per_one: int) -> Column:
    """Whole units; a value that is not finite or out of range counts as missing."""
    return F.rint(value * per_one).try_cast("bigint")


def squared(unit: Column) -> Column:
    return (unit.cast("decimal(18,0)") * unit.cast("decimal(18,0)")).cast(WIDE)


def mean(n: Column, total: Column, per_one: int) -> Column:
    return F.when(n > 0, total.cast("double") / n.cast("double") / per_one)


def population_std(n: Column, total: Column, squares: Column, per_one: int) -> Column:
    """Population deviation, only from two values on."""
    spread = (n.cast("decimal(18,0)") * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    return F.when(n >= 2, F.sqrt(F.greatest(spread, F.lit(0.0))) / n.cast("double") / per_one)


def deviations(value: Column, average: Column, std: Column) -> dict[str, Column]:
    """Difference, ratio and z-score; a zero denominator gives NULL."""
    return {
        "difference": value - average,
        "ratio": F.try_divide(value, average),
        "zscore": F.try_divide(value - average, std),
    }
