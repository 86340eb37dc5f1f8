"""Held positions: parsing, universe, matching and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.params import Params

# The form of an option symbol, of a stock symbol, and rows that are neither.
OPTION = r"^-?([A-Z.]+)(\d{2})(\d{2})(\d{2})([CP])(\d+\.?\d*)$"
STOCK = r"^[A-Z.]{1,10}$"
SKIPPED, SKIPPED_PREFIX = "SPAXX**", "Pending"


def parse_positions(raw: DataFrame, column: str = "Symbol") -> DataFrame:
    """Distinct position keys of a raw table: kind (stock or option), ticker, expiration_date, option_type, strike. Without the column: none."""
    if column not in raw.columns:
        raw = raw.sparkSession.createDataFrame([], f"`{column}` string")
    text = F.trim(F.col(f"`{column}`"))
    packed = F.replace(text, F.lit(" "), F.lit(""))
    kind = (
        F.when(text.isNull() | (text == "") | (text == SKIPPED) | text.startswith(SKIPPED_PREFIX), None)
        .when(text.startswith("-") | F.col(f"`{column}`").contains(" -"), F.when(packed.rlike(OPTION), "option"))
        .when(text.rlike(STOCK), "stock")
    )
    part = lambda k: F.regexp_extract(packed, OPTION, k)
    option = F.col("kind") == "option"
    return (
        raw.select(kind.alias("kind"), text.alias("text"), *(part(k).alias(f"g{k}") for k in range(1, 7)))
        .where("kind is not null")
        .select(
            "kind",
            F.when(option, F.col("g1")).otherwise(F.col("text")).alias("ticker"),
            F.when(option, F.expr("try_to_date(concat('20', g2, '-', g3, '-', g4), 'yyyy-MM-dd')")).alias("expiration_date"),
            F.when(option, F.when(F.col("g5") == "C", "call").otherwise("put")).alias("option_type"),
            F.when(option, F.col("g6").try_cast("double")).alias("strike"),
        )
        .dropDuplicates()
    )


def ticker_universe(configured: DataFrame, positions: DataFrame) -> DataFrame:
    """Configured tickers and, marked as added, held stocks that are not among them."""
    own = configured.select("ticker").distinct()
    held = positions.where("kind = 'stock'").select("ticker").distinct()
    return own.withColumn("is_added", F.lit(False)).unionByName(held.join(own, "ticker", "left_anti").withColumn("is_added", F.lit(True)))


#: Strikes meet by bins of half the tolerance, in their own bin and two to either side.
NEAR_BINS = (-2, -1, 0, 1, 2)


def _bin(strike: Column, params: Params) -> Column:
    return F.floor(strike / (params.strike_tolerance / 2.0))


def _near(positions: DataFrame, params: Params) -> DataFrame:
    """Held options, each in every bin whose strikes it can be close to: _ticker, _expiration, _type, _bin, _offset (its own bin less that one), _strike."""
    options = positions.where("kind = 'option' AND strike IS NOT NULL").select(F.col("ticker").alias("_ticker"), F.col("expiration_date").alias("_expiration"), F.col("option_type").alias("_type"), F.col("strike").alias("_strike")).distinct()
    offsets = F.explode(F.array(*map(F.lit, NEAR_BINS)))
    return options.select("*", offsets.alias("_offset")).withColumn("_bin", _bin(F.col("_strike"), params) - F.col("_offset"))


def _meets(chain: DataFrame, options: DataFrame, params: Params) -> Column:
    return (
        (chain["underlying_symbol"] == options["_ticker"]) & (chain["expiration_date"] == options["_expiration"]) & (chain["option_type"] == options["_type"])
        & (_bin(chain["strike"], params) == options["_bin"])
    )


def with_held(chain: DataFrame, positions: DataFrame, params: Params, name: str = "_held") -> DataFrame:
    """A flag for rows that a held option matches: equal ticker, expiration and type, strikes closer than the tolerance.

    One join on equal keys, with at most one partner for each row: of the strikes in its own bin it needs to know that there are any (all are close), of those
    below only the greatest, of those above only the least.
    """
    strike = F.col("_strike")
    edges = _near(positions, params).groupBy("_ticker", "_expiration", "_type", "_bin").agg(
        F.max(F.col("_offset") == 0).alias("_same"), F.max(F.when(F.col("_offset") < 0, strike)).alias("_below"), F.min(F.when(F.col("_offset") > 0, strike)).alias("_above")
    )
    tolerance = F.lit(params.strike_tolerance)
    near = F.col("_same") | F.coalesce(F.col("strike") - F.col("_below") < tolerance, F.lit(False)) | F.coalesce(F.col("_above") - F.col("strike") < tolerance, F.lit(False))
    return chain.join(edges, _meets(chain, edges, params), "left").withColumn(name, F.coalesce(near, F.lit(False))).drop(*edges.columns)


def match_positions(chain: DataFrame, positions: DataFrame, params: Params, how: str = "left_semi") -> DataFrame:
    """Chain rows that a held option matches (left_semi) or that none does (left_anti). A row that two positions match stands once."""
    if how not in ("left_semi", "left_anti"):
        raise ValueError(how)
    held = with_held(chain, positions, params)
    return held.where(F.col("_held") if how == "left_semi" else ~F.col("_held")).drop("_held")


def position_coverage(positions: DataFrame, chain: DataFrame, params: Params) -> DataFrame:
    """Each held option with the first contract that matches it, by strike and symbol, or none."""
    options = _near(positions, params)
    rows = chain.select("underlying_symbol", "expiration_date", "option_type", "strike", "contract_symbol")
    close = F.abs(F.col("_strike") - F.col("strike")) < params.strike_tolerance
    found = options.join(rows, _meets(rows, options, params), "left").withColumn("_first", F.when(close, F.struct("strike", "contract_symbol")))
    first = found.groupBy("_ticker", "_expiration", "_type", "_strike").agg(F.min("_first").alias("_first"))
    return first.select(
        F.col("_ticker").alias("ticker"), F.col("_expiration").alias("expiration_date"), F.col("_type").alias("option_type"), F.col("_strike").alias("strike"),
        F.col("_first").isNotNull().alias("is_found"), "_first.contract_symbol",
    )


def with_screen_failures(chain: DataFrame, params: Params) -> DataFrame:
    """failed_filters: names of the thresholds that a row misses; a missing value fails."""
    fails = lambda test, name: F.when(~F.coalesce(test, F.lit(False)), F.lit(name))
    tests = [] if params.min_bid is None else [fails(F.col("bid") >= params.min_bid, "filters_min_bid")]
    tests += [
        fails(F.col("bid_ask_spread_pct_of_mid") <= params.max_spread_pct_of_mid, "filters_max_spread_pct_of_mid"),
        fails(F.col("open_interest") >= params.min_open_interest, "filters_min_open_interest"),
        fails(F.col("volume") >= params.min_volume, "filters_min_volume"),
    ]
    return chain.withColumn("failed_filters", F.filter(F.array(*tests), lambda x: x.isNotNull()))
