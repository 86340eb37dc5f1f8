"""Joins that attach underlying snapshots and events, and the choice of expirations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.functions.mathx import holds
from strikeline.operators.screens import seconds_before
from strikeline.params import Params


def attach_snapshot(chain: DataFrame, snapshots: DataFrame, params: Params) -> DataFrame:
    """Price, its time, day change and volatility of the underlying; chains of underlyings without a price above 0 are dropped.

    snapshots has one row per underlying_symbol; columns of the same names in chain give way to it.
    """
    fields = [c for c in ("underlying_price", "underlying_price_time", "underlying_day_change_pct", "historical_volatility") if c in snapshots.columns]
    out = chain.drop(*fields).join(snapshots.select("underlying_symbol", *fields), "underlying_symbol", "left").where("underlying_price > 0")
    age = seconds_before(F.lit(params.as_of), F.col("underlying_price_time"))
    return out.withColumns({"underlying_price_age_seconds": age, "is_stale_underlying_price": age > params.stale_quote_seconds})


def attach_events(chain: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Next earnings and ex-dividend dates and the days until them. events has one row per underlying_symbol."""
    fields = ("next_earnings_date", "next_earnings_date_is_estimated", "next_ex_div_date", "dividend_amount")
    out = chain.drop(*fields).join(events.select("underlying_symbol", *fields), "underlying_symbol", "left")
    days = lambda c: F.datediff(F.col(c), F.lit(params.today))
    return out.withColumns({"days_to_earnings": days("next_earnings_date"), "days_to_ex_div": days("next_ex_div_date")})


def select_expirations(chain: DataFrame, positions: DataFrame, params: Params) -> DataFrame:
    """Expirations up to the last allowed one, from tomorrow on, or from today for underlyings held as stock."""
    stocks = positions.where("kind = 'stock'").select(F.col("ticker").alias("_stock")).distinct()
    days = F.datediff(F.col("expiration_date"), F.lit(params.today))
    marked = chain.join(stocks, chain["underlying_symbol"] == stocks["_stock"], "left")
    first = F.when(F.col("_stock").isNotNull(), 0).otherwise(1)
    return marked.where(holds(F.col("expiration_date") <= F.lit(params.max_expiration)) & holds(days >= first)).drop("_stock")
