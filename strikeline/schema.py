"""The canonical chain: column names in export order and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# The export's columns, in order.
COLUMNS = (
    "underlying_symbol", "contract_symbol", "option_type", "expiration_date", "days_to_expiration", "time_to_expiration_years", "strike",
    "underlying_price", "underlying_day_change_pct", "historical_volatility", "underlying_price_time", "underlying_price_age_seconds",
    "is_stale_underlying_price", "next_earnings_date", "next_earnings_date_is_estimated", "days_to_earnings", "earnings_within_5d",
    "earnings_within_10d", "next_ex_div_date", "days_to_ex_div", "ex_div_within_3d", "dividend_amount", "event_risk_score", "bid", "ask",
    "last_trade_price", "mark_price_mid", "premium_reference_price", "premium_reference_method", "expected_fill_price", "bid_ask_spread",
    "bid_ask_spread_pct_of_mid", "spread_to_strike_pct", "spread_to_bid_pct", "volume", "open_interest", "oi_to_volume_ratio",
    "listed_strike_increment", "implied_volatility", "iv_state_level", "iv_state_term", "change", "percent_change", "option_quote_time",
    "quote_age_seconds", "is_stale_quote", "is_in_the_money", "strike_minus_spot", "strike_vs_spot_pct", "strike_distance_pct", "itm_amount",
    "otm_pct", "intrinsic_value", "extrinsic_value_bid", "extrinsic_value_mid", "extrinsic_value_ask", "extrinsic_pct_mid",
    "has_negative_extrinsic_mid", "premium_to_strike", "premium_to_strike_bid", "premium_to_strike_annualized", "premium_per_day",
    "iv_adjusted_premium_per_day", "estimated_margin_requirement", "return_on_margin", "return_on_margin_annualized", "break_even_if_short",
    "expected_move", "expected_move_pct", "expected_move_lower_bound", "expected_move_upper_bound", "delta", "delta_abs", "delta_safety_pct",
    "delta_itm_proxy", "probability_itm", "gamma", "vega", "vega_per_day", "theta", "theta_dollars_per_day", "theta_to_premium_ratio",
    "capital_required", "theta_efficiency", "theta_efficiency_below_p25", "has_valid_underlying", "has_valid_strike", "has_valid_quote",
    "has_valid_iv", "has_valid_greeks", "bid_le_ask", "has_nonzero_bid", "has_nonzero_ask", "has_crossed_or_locked_market", "is_wide_market",
    "days_bucket", "near_expiry_near_money_flag", "passes_primary_screen", "spread_score", "dte_score", "risk_level", "risk_model_inconsistent",
    "quote_quality_score", "option_score", "score_validation", "score_adjustment", "final_score", "contract_size", "data_source",
    "risk_free_rate_used",
)
# Columns that never leave the engine.
TRANSIENT = (
    "currency", "underlying_currency", "roll_from_expiration_date", "roll_days_added", "roll_from_premium_reference_price", "roll_net_credit",
    "roll_yield", "fetch_status", "fetch_error", "script_version", "fetched_at",
)
QUALITY_FLAGS = (
    "has_valid_underlying", "has_valid_strike", "has_valid_quote", "has_valid_iv", "has_valid_greeks", "bid_le_ask", "has_nonzero_bid",
    "has_nonzero_ask", "has_crossed_or_locked_market", "is_wide_market",
)
STRINGS = frozenset((
    "underlying_symbol", "contract_symbol", "option_type", "premium_reference_method", "iv_state_level", "iv_state_term", "days_bucket",
    "risk_level", "score_validation", "contract_size", "data_source",
))
DATES = frozenset(("expiration_date", "next_earnings_date", "next_ex_div_date"))
TIMESTAMPS = frozenset(("underlying_price_time", "option_quote_time"))
INTEGERS = frozenset(("days_to_expiration", "days_to_earnings", "days_to_ex_div", "quote_quality_score"))
BOOLEANS = frozenset((
    *QUALITY_FLAGS, "is_stale_underlying_price", "is_stale_quote", "is_in_the_money", "next_earnings_date_is_estimated", "earnings_within_5d", "earnings_within_10d",
    "ex_div_within_3d", "has_negative_extrinsic_mid", "theta_efficiency_below_p25", "near_expiry_near_money_flag", "passes_primary_screen", "risk_model_inconsistent",
))


def type_of(column: str) -> T.DataType:
    for names, kind in ((STRINGS, T.StringType()), (DATES, T.DateType()), (TIMESTAMPS, T.TimestampType()), (INTEGERS, T.IntegerType()), (BOOLEANS, T.BooleanType())):
        if column in names:
            return kind
    return T.DoubleType()


CHAIN = T.StructType([T.StructField(c, type_of(c)) for c in COLUMNS])
