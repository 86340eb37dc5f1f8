"""Filters of the enriched chain and of table views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.mathx import holds, number
from strikeline.operators.positions import with_held
from strikeline.params import Params


def in_strike_band(params: Params) -> Column:
    """Strike within the band around spot; every row passes without a spot above 0."""
    spot, p = F.col("underlying_price"), params.max_strike_distance_pct
    return ~holds(spot > 0) | holds(F.col("strike").between(spot * (1 - p), spot * (1 + p)))


def has_bid() -> Column:
    """Not a bid of 0; a missing bid passes."""
    return F.col("bid").isNull() | (F.col("bid") != 0)


def is_tight(params: Params) -> Column:
    return holds(F.col("bid_ask_spread_pct_of_mid") <= params.max_spread_pct_of_mid)


def with_kept(chain: DataFrame, params: Params, positions: DataFrame | None = None, name: str = "_kept") -> DataFrame:
    """A flag for rows that pass the three filters at once, or that a position holds."""
    if not params.enable_filters:
        return chain.withColumn(name, F.lit(True))
    passes = in_strike_band(params) & has_bid() & is_tight(params)
    if positions is None:
        return chain.withColumn(name, passes)
    return with_held(chain, positions, params).withColumn(name, F.col("_held") | passes).drop("_held")


def filter_chain(chain: DataFrame, params: Params, positions: DataFrame | None = None) -> DataFrame:
    """The three filters at once; contracts that a position holds pass all of them."""
    return with_kept(chain, params, positions).where("_kept").drop("_kept") if params.enable_filters else chain


def filter_accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after filtering, and rows dropped, of each underlying."""
    n = lambda df, name: df.groupBy("underlying_symbol").agg(F.count("*").alias(name))
    kept = F.coalesce("kept_rows", F.lit(0))
    return n(before, "raw_rows").join(n(after, "kept_rows"), "underlying_symbol", "left").select("underlying_symbol", "raw_rows", kept.alias("kept_rows"), (F.col("raw_rows") - kept).alias("dropped_rows"))


def range_filter(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within inclusive bounds; with a bound, rows that are no number go."""
    x = number(F.col(column).cast("string"))
    for bound, test in ((low, x >= low if low is not None else None), (high, x <= high if high is not None else None)):
        if bound is not None:
            df = df.where(holds(test))
    return df


def label(column: str) -> Column:
    """A value as a table shows it."""
    text = F.col(column).cast("string")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("—")).otherwise(text)


def value_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(label(column).isin(*values))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(label(column).alias("label")).distinct()
