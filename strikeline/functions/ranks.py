"""Ranks and running counts of groups of any size.

A window over a group puts it into one task. Here a group is cut into buckets that keep the order of its values, the buckets are counted, and a row's rank is the
count of the buckets before its own plus its rank there; so a hot group is spread over its buckets. Only the counts, one row for each bucket, meet in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets between a number and its double; ten times as many would still be few rows.
PER_DOUBLING = 4096
#: The same where the rows of a few buckets are read again: each task sends a row for each bucket, so there are fewer of them.
FEW = 128
#: Exponents of doubles are above -1100, so that buckets of positive numbers are positive.
LOWEST, LAST = 1100, 1 << 40


def bucket(x: Column, per_doubling: int = PER_DOUBLING) -> Column:
    """A whole number that does not fall as x rises: the exponent and the first bits (twelve, by default) of the fraction of a double. Missing stays missing."""
    size = F.abs(x.cast("double"))
    exponent = F.floor(F.log2(size))
    place = F.floor((size / F.pow(F.lit(2.0), exponent.cast("double")) - 1.0) * per_doubling)
    own = F.when(F.isnan(size) | (size == float("inf")), LAST).when(size == 0, 0).otherwise((exponent + LOWEST) * per_doubling + place + 1).cast("long")
    return F.when(x.isNotNull(), F.when(x.cast("double") < 0, -own).otherwise(own))


def text_bucket(x: Column) -> Column:
    """The same for text: its first characters."""
    return F.substring(x, 1, 4)


def _matches(df: DataFrame, keys: list[str]) -> Column:
    test = None
    for k in keys:
        one = df[k].eqNullSafe(F.col(f"_of_{k}"))
        test = one if test is None else test & one
    return test


def sums_before(df: DataFrame, keys: list[str], by: Column, weight: Column, descending: bool = False, missing_last: bool = False) -> DataFrame:
    """One row for each bucket (by) of each group: the keys, `_bucket`, its weight `_sum`, `_before` (weight of the buckets before it) and `_total` (of the group)."""
    sums = df.withColumn("_bucket", by).groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_sum"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    missing = F.col("_bucket").isNull() if missing_last else F.col("_bucket").isNotNull()
    upto = F.sum("_sum").over(group.orderBy(missing, F.col("_bucket").desc() if descending else F.col("_bucket")))
    return sums.select(*keys, "_bucket", "_sum", (upto - F.col("_sum")).alias("_before"), F.sum("_sum").over(group).alias("_total"))


def join_buckets(df: DataFrame, keys: list[str], by: Column, sums: DataFrame) -> DataFrame:
    """The rows whose bucket (by) is among those of sums, with `_bucket`, `_before` and `_total`."""
    cut = df.withColumn("_bucket", by)
    sums = sums.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, "_bucket"]), "_before", "_total")
    return cut.join(sums, _matches(cut, [*keys, "_bucket"]), "inner").drop(*(f"_of_{k}" for k in [*keys, "_bucket"]))


def with_before(df: DataFrame, keys: list[str], by: Column, weight: Column, descending: bool = False, missing_last: bool = False) -> DataFrame:
    """df with `_bucket` (by), `_before` (weight of the buckets before a row's own in its group) and `_total` (of the group). Missing buckets come first or last."""
    return join_buckets(df, keys, by, sums_before(df, keys, by, weight, descending, missing_last))


def with_rank(df: DataFrame, keys: list[str], by: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the rank from 0 of each row of its group in the given ascending order, and `_total`. `by` is the bucket of the first column of the order."""
    cut = with_before(df, keys, by, F.lit(1))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return cut.withColumn(name, (F.col("_before") + own - 1).cast("long")).drop("_bucket", "_before")
