"""Numeric expressions with the missing-value rules of the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def number(x: Column) -> Column:
    """Text as a double; bad text and NaN are missing."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def apart(df: DataFrame) -> DataFrame:
    """The same rows; expressions above and below are compiled apart.

    Spark makes one method of a chain of projections, and the JVM never compiles a method of more than 8,000 bytecodes: it is interpreted, at a
    fraction of the speed. Coalescing to more partitions than there are moves nothing, but ends the generated method. Filters and column pruning pass it.
    """
    return df.coalesce(1 << 30)
