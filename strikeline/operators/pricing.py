"""Moneyness, premium, margin and theta columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strikeline.functions.graph import Definitions, Reader, build
from strikeline.functions.sqlx import at_least, d, holds, ratio, when
from strikeline.params import Params


def _call(c: Reader) -> str:
    return holds(f"{c.option_type} = 'call'")


def _gap(c: Reader) -> str:
    return f"({c.strike} - {c.underlying_price})"


def _inside(c: Reader) -> str:
    return at_least(f"IF({_call(c)}, -{_gap(c)}, {_gap(c)})", 0.0)


def _outside(c: Reader) -> str:
    return at_least(f"IF({_call(c)}, {_gap(c)}, -{_gap(c)})", 0.0)


def _margin(c: Reader) -> str:
    """Premium and the greater of a fifth of the spot, less what is out of the money, and a tenth of spot or strike; missing where either is."""
    base, floor = f"(0.2D * {c.underlying_price} - {_outside(c)})", f"0.1D * IF({_call(c)}, {c.underlying_price}, {c.strike})"
    return f"IF({base} IS NOT NULL AND {floor} IS NOT NULL, {c.premium_reference_price} + greatest({base}, {floor}), NULL)"


def _method(c: Reader) -> str:
    return when((f"{c.mark_price_mid} IS NOT NULL", "'mid'"), (f"{c.bid} IS NOT NULL", "'bid'"), (f"{c.last_trade_price} IS NOT NULL", "'last_trade_price'"), other="'unavailable'")


MONEYNESS: Definitions = {
    "strike_minus_spot": lambda c, p: _gap(c),
    "strike_vs_spot_pct": lambda c, p: ratio(_gap(c), c.underlying_price),
    "strike_distance_pct": lambda c, p: f"abs({ratio(_gap(c), c.underlying_price)})",
    "itm_amount": lambda c, p: _inside(c),
    "otm_pct": lambda c, p: ratio(_outside(c), c.underlying_price),
    "intrinsic_value": lambda c, p: _inside(c),
}

PREMIUM: Definitions = {
    "extrinsic_value_bid": lambda c, p: f"{c.bid} - {c.intrinsic_value}",
    "extrinsic_value_mid": lambda c, p: f"{c.mark_price_mid} - {c.intrinsic_value}",
    "extrinsic_value_ask": lambda c, p: f"{c.ask} - {c.intrinsic_value}",
    "premium_reference_price": lambda c, p: f"coalesce({c.mark_price_mid}, {c.bid}, {c.last_trade_price})",
    "premium_reference_method": lambda c, p: _method(c),
    "expected_fill_price": lambda c, p: f"IF({c.bid_ask_spread_pct_of_mid} <= 0.1D, {c.mark_price_mid}, {c.bid} + 0.25D * {c.bid_ask_spread})",
    "extrinsic_pct_mid": lambda c, p: ratio(c.extrinsic_value_mid, c.mark_price_mid),
    "has_negative_extrinsic_mid": lambda c, p: holds(f"{c.extrinsic_value_mid} < 0"),
    "premium_to_strike": lambda c, p: ratio(c.premium_reference_price, c.strike),
    "premium_to_strike_bid": lambda c, p: ratio(c.bid, c.strike),
    "premium_per_day": lambda c, p: f"{c.expected_fill_price} / {at_least(f'double({c.days_to_expiration})', 1.0)}",
    "premium_to_strike_annualized": lambda c, p: ratio(c.premium_to_strike, c.time_to_expiration_years),
    "iv_adjusted_premium_per_day": lambda c, p: when((f"{c.implied_volatility} > 0", f"{c.premium_per_day} * {c.implied_volatility} / {d(0.30)}")),
}

MARGIN: Definitions = {
    "estimated_margin_requirement": lambda c, p: _margin(c),
    "return_on_margin": lambda c, p: ratio(c.premium_reference_price, c.estimated_margin_requirement),
    "return_on_margin_annualized": lambda c, p: ratio(c.return_on_margin, c.time_to_expiration_years),
}

THETA_CAPITAL: Definitions = {
    "theta_to_premium_ratio": lambda c, p: ratio(f"abs({c.theta})", c.premium_reference_price),
    "theta_dollars_per_day": lambda c, p: f"abs({c.theta}) * 100D",
    "capital_required": lambda c, p: f"IF({_call(c)}, coalesce({c.last_trade_price}, {c.expected_fill_price}, {c.mark_price_mid}), {c.strike}) * 100D",
    "vega_per_day": lambda c, p: ratio(c.vega, f"double({c.days_to_expiration})"),
    "break_even_if_short": lambda c, p: f"IF({_call(c)}, {c.strike} + {c.premium_reference_price}, {c.strike} - {c.premium_reference_price})",
    "theta_efficiency": lambda c, p: when((f"{c.capital_required} > 0", f"abs({c.theta}) * 100D / ({c.capital_required} / 1000D)")),
}


def with_moneyness(chain: DataFrame) -> DataFrame:
    """Distance of strike and spot; whatever is not a call counts as a put."""
    return build(chain, MONEYNESS, Params())


def with_premium(chain: DataFrame) -> DataFrame:
    """Extrinsic values, the reference premium and its yields. Needs quote quality and moneyness."""
    return build(chain, PREMIUM, Params())


def with_margin(chain: DataFrame) -> DataFrame:
    """Margin estimate and return on it. Needs premium."""
    return build(chain, MARGIN, Params())


def with_theta_capital(chain: DataFrame) -> DataFrame:
    """Theta against premium and capital, vega per day, break-even. Needs premium and Greeks."""
    return build(chain, THETA_CAPITAL, Params())
