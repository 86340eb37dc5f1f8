"""Freshness, tiers, screens, scores and event risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.graph import Definition, Definitions, Reader, build
from strikeline.functions.sqlx import clip, d, holds, ladder, time, when
from strikeline.params import Params


def seconds_before(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)


FRESHNESS: Definitions = {
    "quote_age_seconds": lambda c, p: f"(unix_micros({time(p.as_of)}) - unix_micros({c.option_quote_time})) / 1e6D",
    "is_stale_quote": lambda c, p: f"{c.quote_age_seconds} > {p.stale_quote_seconds}",
}


def _spread_score(x: str) -> str:
    falling = f"greatest(0D, 85D * (1D - ({x} - 0.15D) / 0.1D))"
    return when((f"{x} < 0.1D", "100D"), (f"{x} <= 0.15D", "85D"), (f"{x} <= 0.25D", falling), other="0D")


def _dte_score(x: str) -> str:
    return when((f"{x} < 5", "25D"), (f"{x} < 7", "75D"), (f"{x} <= 21", "100D"), (f"{x} <= 35", "85D"), (f"{x} <= 45", "65D"), other="30D")


TIERS: Definitions = {
    "days_bucket": lambda c, p: ladder(c.days_to_expiration, [(10, "'Week_1'"), (18, "'Week_2'"), (26, "'Week_3'")], "'Week_4'"),
    "near_expiry_near_money_flag": lambda c, p: holds(f"{c.days_to_expiration} <= 14 AND {c.strike_distance_pct} <= 0.03D"),
    "spread_score": lambda c, p: _spread_score(c.bid_ask_spread_pct_of_mid),
    "dte_score": lambda c, p: _dte_score(c.days_to_expiration),
}


def _risk_level(x: str, y: str) -> str:
    moderate = f"({x} >= 0.3D AND {x} <= 0.4D) OR ({y} >= 0.25D AND {y} <= 0.35D)"
    return when((f"{x} < 0.3D AND {y} < 0.25D", "'LOW'"), (moderate, "'MODERATE'"), (f"{x} > 0.4D OR {y} > 0.35D", "'HIGH'"), other="'UNKNOWN'")


RISK: Definitions = {
    "risk_level": lambda c, p: _risk_level(c.delta_abs, c.probability_itm),
    "risk_model_inconsistent": lambda c, p: f"abs({c.delta_abs} - {c.probability_itm}) > 0.15D",
}


def _passes(c: Reader, p: Params) -> str:
    tests = [f"{c.bid_ask_spread_pct_of_mid} <= {d(p.max_spread_pct_of_mid)}", f"{c.open_interest} >= {p.min_open_interest}", f"{c.volume} >= {p.min_volume}"]
    if p.min_bid is not None:
        tests.append(f"{c.bid} >= {d(p.min_bid)}")
    return " AND ".join(map(holds, tests))


SCREEN: Definitions = {
    "is_wide_market": lambda c, p: holds(f"{c.bid_ask_spread_pct_of_mid} > {d(p.max_spread_pct_of_mid)}"),
    "passes_primary_screen": _passes,
}


def _signs(c: Reader) -> str:
    good = [c.has_valid_quote, c.has_nonzero_bid, c.has_nonzero_ask, c.has_valid_iv, c.has_valid_greeks]
    return " + ".join(f"int({x})" for x in [*good, f"NOT {c.has_crossed_or_locked_market}", f"NOT coalesce({c.is_stale_quote}, false)"])


QUALITY_SCORE: Definitions = {"quote_quality_score": lambda c, p: _signs(c)}

SCORED = (
    "premium_per_day", "bid", "ask", "open_interest", "volume", "delta_abs", "probability_itm", "days_to_expiration", "strike", "underlying_price",
    "iv_adjusted_premium_per_day", "spread_score", "dte_score", "theta_efficiency",
)


def _weights(p: Params) -> tuple[float, ...]:
    return p.income_weight, p.liquidity_weight, p.risk_weight, p.efficiency_weight


def _scored(made: Definition, kind: str) -> Definition:
    """Missing where no component has any weight."""
    return lambda c, p: made(c, p) if sum(_weights(p)) > 0 else f"CAST(NULL AS {kind})"


def _option_score(c: Reader, p: Params) -> str:
    """A weighted mean of income, spread, risk and efficiency, each from 0 to 1, where all that it reads is there."""
    efficiency = f"(0.5D * {clip(f'{c.dte_score} / 100D', 0.0, 1.0)} + 0.5D * {clip(f'{c.theta_efficiency} / 15D', 0.0, 1.0)})"
    risk = when((f"{c.delta_abs} < 0.3D", "1D"), (f"{c.delta_abs} <= 0.4D", "0.75D"), other="0.35D")
    parts = zip((c._income, clip(f"{c.spread_score} / 100D", 0.0, 1.0), risk, efficiency), _weights(p), strict=True)
    mean = f"least(greatest(({' + '.join(f'{x} * {d(w)}' for x, w in parts)}) / {d(sum(_weights(p)))}, 0D), 1D)"
    there = " AND ".join(f"{c[name]} IS NOT NULL" for name in SCORED)
    return when((f"{c.option_type} IN ('call', 'put') AND {there}", f"{mean} * 100D"))


def _validation(c: Reader, p: Params) -> str:
    score = c.option_score
    return when(
        (f"{score} IS NULL", "CAST(NULL AS string)"), (f"{score} >= 70 AND ({c._income} < 0.35D OR {c.spread_score} < 50)", "'DISCREPANCY'"),
        (f"{score} < 50 AND {c._income} >= 0.6D AND {c.spread_score} >= 70", "'UNDERVALUED'"), other="'ALIGNED'",
    )


def _adjustment(c: Reader, p: Params) -> str:
    return when((f"{c.score_validation} = 'DISCREPANCY'", "-10D"), (f"{c.score_validation} = 'UNDERVALUED'", "5D"), other="0D")


OPTION_SCORE: Definitions = {
    "_income": lambda c, p: clip(f"({c.iv_adjusted_premium_per_day} - 0.01D) / 0.04D", 0.0, 1.0),
    "option_score": _scored(_option_score, "double"),
    "score_validation": _scored(_validation, "string"),
    "score_adjustment": _scored(_adjustment, "double"),
    "final_score": _scored(lambda c, p: clip(f"({c.option_score} + {c.score_adjustment})", 0.0, 100.0), "double"),
}


def _spans(c: Reader, days: str) -> str:
    """The event comes before expiration."""
    return f"({days} IS NOT NULL AND ({c.days_to_expiration} IS NULL OR ({days} >= 0 AND {days} <= {c.days_to_expiration})))"


def _points(c: Reader) -> str:
    first = f"IF({c._spans_earnings}, {ladder(c.days_to_earnings, [(5, '60D'), (10, '30D')], '0D')}, 0D)"
    second = f"IF({c._spans_dividend}, {ladder(c.days_to_ex_div, [(3, '40D'), (7, '20D')], '0D')}, 0D)"
    return when((f"{c._spans_earnings} OR {c._spans_dividend}", f"least({first} + {second}, 100D)"))


EVENT_RISK: Definitions = {
    "_spans_earnings": lambda c, p: _spans(c, c.days_to_earnings),
    "_spans_dividend": lambda c, p: _spans(c, c.days_to_ex_div),
    "earnings_within_5d": lambda c, p: when((c._spans_earnings, f"{c.days_to_earnings} <= 5")),
    "earnings_within_10d": lambda c, p: when((c._spans_earnings, f"{c.days_to_earnings} <= 10")),
    "ex_div_within_3d": lambda c, p: when((c._spans_dividend, f"{c.days_to_ex_div} <= 3")),
    "event_risk_score": lambda c, p: _points(c),
}


def with_freshness(chain: DataFrame, params: Params) -> DataFrame:
    return build(chain, FRESHNESS, params)


def with_tiers(chain: DataFrame) -> DataFrame:
    """Buckets and scores by tenor and spread; a missing tenor is in the last bucket, a missing spread scores 0."""
    return build(chain, TIERS, Params())


def with_risk(chain: DataFrame) -> DataFrame:
    return build(chain, RISK, Params())


def with_screen(chain: DataFrame, params: Params) -> DataFrame:
    return build(chain, SCREEN, params)


def with_quality_score(chain: DataFrame) -> DataFrame:
    """Number of good signs, 0 to 7; an unknown age counts as fresh."""
    return build(chain, QUALITY_SCORE, Params())


def with_option_score(chain: DataFrame, params: Params) -> DataFrame:
    """option_score, score_validation, score_adjustment and final_score, on 0 to 100; missing where an input is."""
    return build(chain, OPTION_SCORE, params)


def with_event_risk(chain: DataFrame) -> DataFrame:
    """Flags and points of the next earnings and ex-dividend dates that fall before expiration; missing where none does."""
    return build(chain, EVENT_RISK, Params())
