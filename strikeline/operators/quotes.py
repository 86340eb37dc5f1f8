"""Quote-quality columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strikeline.functions.graph import Definitions, build
from strikeline.functions.sqlx import holds, ratio, when
from strikeline.params import Params

QUOTE_QUALITY: Definitions = {
    "has_valid_underlying": lambda c, p: holds(f"{c.underlying_price} > 0"),
    "has_valid_strike": lambda c, p: holds(f"{c.strike} > 0"),
    "bid_le_ask": lambda c, p: holds(f"{c.bid} <= {c.ask}"),
    "has_nonzero_bid": lambda c, p: holds(f"{c.bid} > 0"),
    "has_nonzero_ask": lambda c, p: holds(f"{c.ask} > 0"),
    "has_crossed_or_locked_market": lambda c, p: holds(f"{c.bid} >= {c.ask}"),
    "has_valid_quote": lambda c, p: holds(f"{c.bid} >= 0 AND {c.ask} >= 0 AND {c.bid} <= {c.ask}"),
    "has_valid_iv": lambda c, p: holds(f"{c.implied_volatility} > 0"),
    "oi_to_volume_ratio": lambda c, p: ratio(f"double({c.open_interest})", f"double({c.volume})"),
    "mark_price_mid": lambda c, p: when((c.has_valid_quote, f"({c.bid} + {c.ask}) / 2D")),
    "bid_ask_spread": lambda c, p: when((c.has_valid_quote, f"{c.ask} - {c.bid}")),
    "bid_ask_spread_pct_of_mid": lambda c, p: ratio(c.bid_ask_spread, c.mark_price_mid),
    "spread_to_strike_pct": lambda c, p: ratio(c.bid_ask_spread, c.strike),
    "spread_to_bid_pct": lambda c, p: ratio(c.bid_ask_spread, c.bid),
}


def with_quote_quality(chain: DataFrame) -> DataFrame:
    """Validity flags, mid, spread and liquidity ratios. Flags are never missing; prices are missing without a valid quote."""
    return build(chain, QUOTE_QUALITY, Params())
