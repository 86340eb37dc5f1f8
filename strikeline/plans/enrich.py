"""The whole plan from normalised rows to the canonical chain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.functions import graph
from strikeline.functions.mathx import apart
from strikeline.functions.shared import stored
from strikeline.operators import filters, greeks, groups, pricing, quotes, screens
from strikeline.params import Params


GREEKS = (
    "delta", "probability_itm", "gamma", "vega", "theta", "delta_abs", "delta_safety_pct", "delta_itm_proxy", "has_valid_greeks",
)
SCORES = ("quote_quality_score", "option_score", "score_validation", "score_adjustment", "final_score")
#: A filter of rankings; in terms of the quote it is a method of 15,000 bytecodes, which the JVM never compiles.
SCREENED = ("passes_primary_screen",)


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; a later filter on these columns reads their values and is not rewritten in terms of what they were made of.

    Catalyst moves filters below projections by putting each column's expression in its place. Scores are built on Greeks in many
    layers, and that expression would grow without bound. Filters on all other columns still reach the scan.
    """
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*columns))))


#: Every column that depends on its own row alone.
ROW_COLUMNS = {
    **quotes.QUOTE_QUALITY, **pricing.MONEYNESS, **pricing.PREMIUM, **pricing.MARGIN, **greeks.GREEKS, **pricing.THETA_CAPITAL, **screens.FRESHNESS, **screens.TIERS,
    **screens.RISK, **screens.SCREEN, **screens.QUALITY_SCORE, **screens.EVENT_RISK, **screens.OPTION_SCORE,
}


def enrich_rows(chain: DataFrame, params: Params, settled: bool = True, columns: Iterable[str] | None = None, packed: bool = False) -> DataFrame:
    """All columns that depend on their own row alone, or just the given ones; no shuffle. Settled Greeks and scores can be filtered by;
    packed (see graph) ones that nobody filters by are built with less copying."""
    out = graph.build(chain, ROW_COLUMNS, params, columns, only=columns is not None, packed=packed)
    held = [c for c in (*GREEKS, *SCORES, *SCREENED) if c in out.columns]
    return settle(out, held) if settled and held else out


#: What group statistics read.
STATISTICS = (
    "snapshot_date", "underlying_symbol", "option_type", "expiration_date", "strike", "contract_symbol", "underlying_price", "time_to_expiration_years",
    "implied_volatility", "strike_distance_pct", "theta_efficiency",
)


def with_flag(chain: DataFrame, params: Params, positions: DataFrame | None, columns: Iterable[str]) -> DataFrame:
    """The given columns and `_kept`, whether a row passes the filters or is held."""
    read = dict.fromkeys((*columns, "bid", "strike", "underlying_symbol", "option_type", "expiration_date", "underlying_price", "bid_ask_spread_pct_of_mid"))
    return filters.with_kept(enrich_rows(chain, params, settled=False, columns=read), params, positions).select(*columns, "_kept")


def full_chain(chain: DataFrame, params: Params, positions: DataFrame | None = None) -> DataFrame:
    """Row columns, then statistics of the unfiltered chain, then filters, then statistics of what they leave.

    The columns that statistics need are computed once and stored; every statistic reads that narrow table. The chain is read once more for its rows, which are filtered
    and get their statistics before all their columns are computed: filters and joins move narrow rows only.
    """
    if positions is not None:
        positions = stored(positions)  # of a known size, and parsed once
    every = stored(with_flag(chain, params, positions, STATISTICS))
    rows = with_flag(chain, params, positions, chain.columns).where("_kept").drop("_kept")
    rows = groups.with_all(apart(rows), every, every.where("_kept"), stored)
    return graph.build(rows, ROW_COLUMNS | groups.BELOW_P25, params, packed=True).drop("_p25")
