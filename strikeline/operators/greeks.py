"""Black-Scholes Greeks as native expressions; vendor values come first where a chain has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strikeline.functions.graph import Definition, Definitions, Reader, build
from strikeline.functions.sqlx import d, holds, norm_cdf, norm_pdf, tail_size, when
from strikeline.params import Params


def _call(c: Reader) -> str:
    return holds(f"{c.option_type} = 'call'")


def _sigma(c: Reader) -> str:
    return f"coalesce(nullif({c.implied_volatility}, 0D), 0.3D)"


def _valid(c: Reader) -> str:
    return holds(f"{c.underlying_price} > 0 AND {c.strike} > 0 AND {c.time_to_expiration_years} > 0 AND {_sigma(c)} > 0")


def _scale(c: Reader) -> str:
    return f"({c._sigma} * sqrt({c.time_to_expiration_years}))"


def _d1(c: Reader, p: Params) -> str:
    drift = f"({d(p.risk_free_rate)} + {c._sigma} * {c._sigma} / 2D) * {c.time_to_expiration_years}"
    return when((c._valid, f"(ln({c.underlying_price} / {c.strike}) + {drift}) / {_scale(c)}"))


def _theta(c: Reader, p: Params) -> str:
    decay = f"-({c.underlying_price} * {c._p1} * {c._sigma}) / (2D * sqrt({c.time_to_expiration_years}))"
    carry = f"{d(p.risk_free_rate)} * {c.strike} * {c._discount}"
    return when((c._valid, f"IF({_call(c)}, {decay} - {carry} * {c._n2}, {decay} + {carry} * (1D - {c._n2})) / 365D"))


def _vendor_first(name: str, made: Callable[[Reader, Params], str]) -> Definition:
    """The vendor's value where the chain has such a column and it is not missing."""

    def define(c: Reader, p: Params) -> str:
        given = c.given(name)
        return made(c, p) if given is None else f"coalesce({given}, {made(c, p)})"

    return define


#: d1 and d2, then their distribution values, then the Greeks are columns of their own, so that no long expression is repeated.
GREEKS: Definitions = {
    "_sigma": lambda c, p: _sigma(c),
    "_valid": lambda c, p: _valid(c),
    "_discount": lambda c, p: f"exp({d(-p.risk_free_rate)} * {c.time_to_expiration_years})",
    "_d1": _d1,
    "_d2": lambda c, p: f"{c._d1} - {_scale(c)}",
    "_z1": lambda c, p: tail_size(c._d1),
    "_z2": lambda c, p: tail_size(f"({c._d1} - {_scale(c)})"),
    "_p1": lambda c, p: norm_pdf(c._d1),
    "_n1": lambda c, p: norm_cdf(c._d1, c._z1),
    "_n2": lambda c, p: norm_cdf(c._d2, c._z2),
    "delta": _vendor_first("delta", lambda c, p: f"IF({_call(c)}, {c._n1}, {c._n1} - 1D)"),
    "probability_itm": _vendor_first("probability_itm", lambda c, p: f"IF({_call(c)}, {c._n2}, 1D - {c._n2})"),
    "gamma": _vendor_first("gamma", lambda c, p: when((c._valid, f"{c._p1} / ({c.underlying_price} * {_scale(c)})"))),
    "vega": _vendor_first("vega", lambda c, p: when((c._valid, f"{c.underlying_price} * {c._p1} * sqrt({c.time_to_expiration_years}) / 100D"))),
    "theta": _vendor_first("theta", _theta),
    "delta_abs": _vendor_first("delta_abs", lambda c, p: f"abs({c.delta})"),
    "delta_safety_pct": _vendor_first("delta_safety_pct", lambda c, p: f"(1D - {c.delta_abs}) * 100D"),
    "delta_itm_proxy": _vendor_first("delta_itm_proxy", lambda c, p: f"IF({_call(c)}, {c.delta}, {c.delta_abs})"),
    "has_valid_greeks": lambda c, p: f"{c._valid} OR {c.delta} IS NOT NULL",
}


def with_greeks(chain: DataFrame, params: Params) -> DataFrame:
    """delta, probability_itm, gamma, vega (per point of volatility), theta (per day) and what follows from delta.

    Volatility that is missing or 0 counts as 0.3; rows without spot, strike, time or volatility above 0 have no derived values.
    """
    return build(chain, GREEKS, params)
