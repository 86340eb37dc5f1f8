"""DuckDB SQL over the same Parquet tables, written apart from the operators, that gives each query's rows."""

from __future__ import annotations

from strikeline.functions.sqlx import P, Q, ROOT_TWO_PI
from strikeline.schema import BOOLEANS, COLUMNS, DATES, INTEGERS, STRINGS, TIMESTAMPS

#: Added before rounding to six places: decimal fractions that end in 5 then round alike in both engines.
NUDGE = 1e-10
TODAY, NOW = "DATE '2002-01-02'", "TIMESTAMP '2002-01-02 21:00:00'"


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for k in coefficients[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def _cdf(x: str) -> str:
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2e0)"
    fraction = f"({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0)))))"
    tail = f"CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {e} * {_horner(z, P)} / {_horner(z, Q)} ELSE {e} / ({fraction} * 2.506628274631e0) END"
    return f"CASE WHEN {x} > 0 THEN 1e0 - ({tail}) WHEN {x} IS NOT NULL THEN ({tail}) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def _floor0(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0e0) END"


def _clip(x: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


CHAIN = f"""
base AS (
  SELECT l.*, CAST(substr(p_brand, 7) AS INTEGER) AS n, floor(l_extendedprice / 100e0) AS price FROM lineitem l JOIN part ON l_partkey = p_partkey
), chain AS (
  SELECT {TODAY} AS snapshot_date, 'TK' || chr(64 + n) AS underlying_symbol, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS contract_symbol,
    CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS option_type,
    CAST({TODAY} + CAST(7 * (l_partkey % 13) AS INTEGER) AS DATE) AS expiration_date, CAST(7 * (l_partkey % 13) AS BIGINT) AS days_to_expiration,
    CAST(7 * (l_partkey % 13) AS DOUBLE) / 365e0 AS time_to_expiration_years, (2.5e0 + 0.5e0 * n) * (10 + l_suppkey % 21) AS strike, 50e0 + 10e0 * n AS underlying_price,
    (n - 13) / 500e0 AS underlying_day_change_pct, 0.2e0 + n / 100e0 AS historical_volatility, {NOW} - to_seconds(n * 900) AS underlying_price_time,
    CAST(n * 900 AS DOUBLE) AS underlying_price_age_seconds, n * 900 > 10800 AS is_stale_underlying_price, CAST({TODAY} + 3 * n AS DATE) AS next_earnings_date,
    n % 2 = 0 AS next_earnings_date_is_estimated, 3 * n AS days_to_earnings, CASE WHEN n % 5 <> 0 THEN CAST({TODAY} + 2 * n AS DATE) END AS next_ex_div_date,
    CASE WHEN n % 5 <> 0 THEN 2 * n END AS days_to_ex_div, CASE WHEN n % 5 <> 0 THEN n / 10e0 END AS dividend_amount,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL WHEN l_discount = 0 THEN 0e0 ELSE price / 100e0 END AS bid,
    CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' AND l_quantity < 5 THEN (price - 1e0) / 100e0 ELSE floor(price * (1e0 + 4e0 * l_discount)) / 100e0 END AS ask,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE (price + l_linenumber) / 100e0 END AS last_trade_price,
    CAST(l_quantity AS BIGINT) AS volume, CAST(l_quantity * l_linenumber * 4 AS BIGINT) AS open_interest,
    CASE WHEN l_tax = 0 THEN NULL ELSE 0.1e0 + 5e0 * l_tax + 0.02e0 * l_linenumber END AS implied_volatility,
    {NOW} - to_seconds((l_orderkey * 37 + l_suppkey * 11) % 30000) AS option_quote_time, 'tpch' AS data_source, 0.045e0 AS risk_free_rate_used,
    l_orderkey AS o, l_linenumber AS line, n FROM base
)"""

ROWS = (
    CHAIN
    + f""", quality AS (
  SELECT *, coalesce(underlying_price > 0, false) AS has_valid_underlying, coalesce(strike > 0, false) AS has_valid_strike, coalesce(bid <= ask, false) AS bid_le_ask,
    coalesce(bid > 0, false) AS has_nonzero_bid, coalesce(ask > 0, false) AS has_nonzero_ask, coalesce(bid >= ask, false) AS has_crossed_or_locked_market,
    coalesce(bid >= 0 AND ask >= 0 AND bid <= ask, false) AS has_valid_quote, coalesce(implied_volatility > 0, false) AS has_valid_iv,
    CASE WHEN volume > 0 THEN open_interest / CAST(volume AS DOUBLE) END AS oi_to_volume_ratio FROM chain
), mids AS (
  SELECT *, CASE WHEN has_valid_quote THEN (bid + ask) / 2e0 END AS mark_price_mid, CASE WHEN has_valid_quote THEN ask - bid END AS bid_ask_spread FROM quality
), money AS (
  SELECT *, {_ratio("bid_ask_spread", "mark_price_mid")} AS bid_ask_spread_pct_of_mid, {_ratio("bid_ask_spread", "strike")} AS spread_to_strike_pct,
    {_ratio("bid_ask_spread", "bid")} AS spread_to_bid_pct, strike - underlying_price AS strike_minus_spot, (strike - underlying_price) / underlying_price AS strike_vs_spot_pct,
    abs((strike - underlying_price) / underlying_price) AS strike_distance_pct,
    greatest(CASE option_type WHEN 'call' THEN underlying_price - strike ELSE strike - underlying_price END, 0e0) AS itm_amount,
    greatest(CASE option_type WHEN 'call' THEN strike - underlying_price ELSE underlying_price - strike END, 0e0) AS otm_amount FROM mids
), premium AS (
  SELECT *, itm_amount AS intrinsic_value, otm_amount / underlying_price AS otm_pct, bid - itm_amount AS extrinsic_value_bid, mark_price_mid - itm_amount AS extrinsic_value_mid,
    ask - itm_amount AS extrinsic_value_ask, coalesce(mark_price_mid, bid, last_trade_price) AS premium_reference_price,
    CASE WHEN mark_price_mid IS NOT NULL THEN 'mid' WHEN bid IS NOT NULL THEN 'bid' WHEN last_trade_price IS NOT NULL THEN 'last_trade_price' ELSE 'unavailable' END AS premium_reference_method,
    CASE WHEN bid_ask_spread_pct_of_mid <= 0.1e0 THEN mark_price_mid ELSE bid + 0.25e0 * bid_ask_spread END AS expected_fill_price FROM money
), yields AS (
  SELECT *, {_ratio("extrinsic_value_mid", "mark_price_mid")} AS extrinsic_pct_mid, coalesce(extrinsic_value_mid < 0, false) AS has_negative_extrinsic_mid,
    {_ratio("premium_reference_price", "strike")} AS premium_to_strike, {_ratio("bid", "strike")} AS premium_to_strike_bid,
    expected_fill_price / greatest(CAST(days_to_expiration AS DOUBLE), 1e0) AS premium_per_day,
    premium_reference_price + greatest(0.2e0 * underlying_price - otm_amount, 0.1e0 * CASE option_type WHEN 'call' THEN underlying_price ELSE strike END) AS estimated_margin_requirement FROM premium
), margins AS (
  SELECT *, {_ratio("premium_to_strike", "time_to_expiration_years")} AS premium_to_strike_annualized,
    CASE WHEN implied_volatility > 0 THEN premium_per_day * implied_volatility / 0.3e0 END AS iv_adjusted_premium_per_day,
    {_ratio("premium_reference_price", "estimated_margin_requirement")} AS return_on_margin,
    CASE WHEN coalesce(implied_volatility, 0) = 0 THEN 0.3e0 ELSE implied_volatility END AS sigma,
    coalesce(underlying_price > 0 AND strike > 0 AND time_to_expiration_years > 0, false) AS valid FROM yields
), d AS (
  SELECT *, {_ratio("return_on_margin", "time_to_expiration_years")} AS return_on_margin_annualized, sigma * sqrt(time_to_expiration_years) AS scale,
    CASE WHEN valid THEN (ln(underlying_price / strike) + (0.045e0 + sigma * sigma / 2e0) * time_to_expiration_years) / (sigma * sqrt(time_to_expiration_years)) END AS d1 FROM margins
), dd AS (SELECT *, d1 - scale AS d2, exp(-0.045e0 * time_to_expiration_years) AS discount FROM d
), nn AS (SELECT *, {_cdf("d1")} AS n1, {_cdf("d2")} AS n2, exp(-d1 * d1 / 2e0) / {ROOT_TWO_PI!r}::DOUBLE AS p1 FROM dd
), greeks AS (
  SELECT *, CASE option_type WHEN 'call' THEN n1 ELSE n1 - 1e0 END AS delta, CASE option_type WHEN 'call' THEN n2 ELSE 1e0 - n2 END AS probability_itm,
    CASE WHEN valid THEN p1 / (underlying_price * scale) END AS gamma, CASE WHEN valid THEN underlying_price * p1 * sqrt(time_to_expiration_years) / 100e0 END AS vega,
    CASE WHEN valid THEN (-(underlying_price * p1 * sigma) / (2e0 * sqrt(time_to_expiration_years))
      + CASE option_type WHEN 'call' THEN -0.045e0 * strike * discount * n2 ELSE 0.045e0 * strike * discount * (1e0 - n2) END) / 365e0 END AS theta FROM nn
), more AS (
  SELECT *, abs(delta) AS delta_abs, (1e0 - abs(delta)) * 100e0 AS delta_safety_pct, CASE option_type WHEN 'call' THEN delta ELSE abs(delta) END AS delta_itm_proxy,
    valid OR delta IS NOT NULL AS has_valid_greeks, {_ratio("abs(theta)", "premium_reference_price")} AS theta_to_premium_ratio, abs(theta) * 100e0 AS theta_dollars_per_day,
    100e0 * CASE option_type WHEN 'call' THEN coalesce(last_trade_price, expected_fill_price, mark_price_mid) ELSE strike END AS capital_required,
    CASE WHEN days_to_expiration > 0 THEN vega / days_to_expiration END AS vega_per_day,
    CASE option_type WHEN 'call' THEN strike + premium_reference_price ELSE strike - premium_reference_price END AS break_even_if_short,
    epoch({NOW} - option_quote_time)::DOUBLE AS quote_age_seconds FROM greeks
), tiers AS (
  SELECT *, CASE WHEN capital_required > 0 THEN theta_dollars_per_day / (capital_required / 1000e0) END AS theta_efficiency, quote_age_seconds > 10800 AS is_stale_quote,
    CASE WHEN days_to_expiration <= 10 THEN 'Week_1' WHEN days_to_expiration <= 18 THEN 'Week_2' WHEN days_to_expiration <= 26 THEN 'Week_3' ELSE 'Week_4' END AS days_bucket,
    coalesce(days_to_expiration <= 14 AND strike_distance_pct <= 0.03e0, false) AS near_expiry_near_money_flag,
    CASE WHEN bid_ask_spread_pct_of_mid < 0.1e0 THEN 100e0 WHEN bid_ask_spread_pct_of_mid <= 0.15e0 THEN 85e0
      WHEN bid_ask_spread_pct_of_mid <= 0.25e0 THEN greatest(0e0, 85e0 * (1e0 - (bid_ask_spread_pct_of_mid - 0.15e0) / 0.1e0)) ELSE 0e0 END AS spread_score,
    CASE WHEN days_to_expiration < 5 THEN 25e0 WHEN days_to_expiration < 7 THEN 75e0 WHEN days_to_expiration <= 21 THEN 100e0 WHEN days_to_expiration <= 35 THEN 85e0
      WHEN days_to_expiration <= 45 THEN 65e0 ELSE 30e0 END AS dte_score,
    CASE WHEN delta_abs < 0.3e0 AND probability_itm < 0.25e0 THEN 'LOW' WHEN delta_abs BETWEEN 0.3e0 AND 0.4e0 OR probability_itm BETWEEN 0.25e0 AND 0.35e0 THEN 'MODERATE'
      WHEN delta_abs > 0.4e0 OR probability_itm > 0.35e0 THEN 'HIGH' ELSE 'UNKNOWN' END AS risk_level,
    abs(delta_abs - probability_itm) > 0.15e0 AS risk_model_inconsistent, coalesce(bid_ask_spread_pct_of_mid > 0.25e0, false) AS is_wide_market,
    coalesce(bid_ask_spread_pct_of_mid <= 0.25e0, false) AND coalesce(open_interest >= 100, false) AND coalesce(volume >= 10, false) AS passes_primary_screen FROM more
), scores AS (
  SELECT *, has_valid_quote::INT + has_nonzero_bid::INT + has_nonzero_ask::INT + has_valid_iv::INT + has_valid_greeks::INT + (NOT has_crossed_or_locked_market)::INT
      + (NOT coalesce(is_stale_quote, false))::INT AS quote_quality_score,
    {_clip("((iv_adjusted_premium_per_day - 0.01e0) / 0.04e0)")} AS income,
    CASE WHEN premium_per_day IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND delta_abs IS NOT NULL AND probability_itm IS NOT NULL AND iv_adjusted_premium_per_day IS NOT NULL
      AND theta_efficiency IS NOT NULL THEN 100e0 * {_clip(f'''((0.3e0 * {_clip("((iv_adjusted_premium_per_day - 0.01e0) / 0.04e0)")} + 0.3e0 * {_clip("(spread_score / 100e0)")}
        + 0.25e0 * CASE WHEN delta_abs < 0.3e0 THEN 1e0 WHEN delta_abs <= 0.4e0 THEN 0.75e0 ELSE 0.35e0 END
        + 0.15e0 * (0.5e0 * dte_score / 100e0 + 0.5e0 * {_clip("(theta_efficiency / 15e0)")})) / (0.3e0 + 0.3e0 + 0.25e0 + 0.15e0))''')} END AS option_score,
    days_to_earnings BETWEEN 0 AND days_to_expiration AS earns, coalesce(days_to_ex_div BETWEEN 0 AND days_to_expiration, false) AS pays FROM tiers
), verdicts AS (
  SELECT *, CASE WHEN option_score IS NULL THEN NULL WHEN option_score >= 70 AND (income < 0.35e0 OR spread_score < 50) THEN 'DISCREPANCY'
      WHEN option_score < 50 AND income >= 0.6e0 AND spread_score >= 70 THEN 'UNDERVALUED' ELSE 'ALIGNED' END AS score_validation,
    CASE WHEN earns THEN days_to_earnings <= 5 END AS earnings_within_5d, CASE WHEN earns THEN days_to_earnings <= 10 END AS earnings_within_10d, CASE WHEN pays THEN days_to_ex_div <= 3 END AS ex_div_within_3d,
    CASE WHEN earns OR pays THEN least(100e0, CASE WHEN NOT earns THEN 0e0 WHEN days_to_earnings <= 5 THEN 60e0 WHEN days_to_earnings <= 10 THEN 30e0 ELSE 0e0 END
      + CASE WHEN NOT pays THEN 0e0 WHEN days_to_ex_div <= 3 THEN 40e0 WHEN days_to_ex_div <= 7 THEN 20e0 ELSE 0e0 END) END AS event_risk_score FROM scores
), adjusted AS (
  SELECT *, CASE score_validation WHEN 'DISCREPANCY' THEN -10e0 WHEN 'UNDERVALUED' THEN 5e0 ELSE 0e0 END AS score_adjustment FROM verdicts
), enriched AS (
  SELECT *, {_clip("(option_score + score_adjustment)", "0e0", "100e0")} AS final_score FROM adjusted
)"""
)

LEVEL = ROWS + """, level_stats AS (
  SELECT underlying_symbol, count(implied_volatility) FILTER (implied_volatility > 0) AS c, quantile_cont(implied_volatility, 0.3) FILTER (implied_volatility > 0) AS p30,
    quantile_cont(implied_volatility, 0.7) FILTER (implied_volatility > 0) AS p70,
    arg_min(implied_volatility, row(expiration_date, strike_distance_pct, option_type, strike, contract_symbol)) FILTER (implied_volatility > 0) AS iv FROM enriched GROUP BY 1
), levels AS (
  SELECT underlying_symbol, CASE WHEN c < 5 THEN 'UNKNOWN' WHEN iv >= p70 THEN 'HIGH' WHEN iv <= p30 THEN 'LOW' ELSE 'NEUTRAL' END AS iv_state_level FROM level_stats
)"""
TERM = """, medians AS (
  SELECT underlying_symbol, expiration_date, median(implied_volatility) AS m FROM enriched WHERE implied_volatility > 0 GROUP BY 1, 2
), firsts AS (
  SELECT underlying_symbol, m, lead(m) OVER w AS m2, row_number() OVER w AS k FROM medians WINDOW w AS (PARTITION BY underlying_symbol ORDER BY expiration_date)
), terms AS (
  SELECT underlying_symbol, CASE WHEN m2 IS NULL THEN 'UNKNOWN' WHEN m2 / m >= 1.05e0 THEN 'RISING' WHEN m2 / m <= 0.95e0 THEN 'FALLING' ELSE 'FLAT' END AS iv_state_term FROM firsts WHERE k = 1
)"""
STEP = """, strikes AS (SELECT DISTINCT underlying_symbol, option_type, expiration_date, strike FROM enriched WHERE strike > 0
), steps AS (
  SELECT *, strike - lag(strike) OVER (PARTITION BY underlying_symbol, option_type, expiration_date ORDER BY strike) AS step FROM strikes
), listed AS (
  SELECT underlying_symbol, option_type, expiration_date, min(step) AS step FROM steps GROUP BY 1, 2, 3 HAVING count(*) >= 3
), increments AS (SELECT underlying_symbol, option_type, arg_min(step, expiration_date) AS listed_strike_increment FROM listed GROUP BY 1, 2)"""
MOVE = """, usable AS (
  SELECT *, min(strike_distance_pct) OVER (PARTITION BY underlying_symbol, expiration_date) AS least FROM {source}
  WHERE underlying_price > 0 AND time_to_expiration_years > 0 AND implied_volatility > 0
), moves AS (
  SELECT underlying_symbol, expiration_date, max(underlying_price) AS s, max(underlying_price) * avg(implied_volatility) * sqrt(max(time_to_expiration_years)) AS move FROM usable
  WHERE abs(strike_distance_pct - least) <= 1e-8 + 1e-5 * abs(least) GROUP BY 1, 2
)"""
QUARTILE = ", quartiles AS (SELECT underlying_symbol, option_type, quantile_cont(theta_efficiency, 0.25) AS p25 FROM {source} GROUP BY 1, 2)"

POSITIONS = """, symbols AS (
  SELECT unnest([' -' || underlying_symbol || strftime(expiration_date, '%y%m%d') || CASE option_type WHEN 'call' THEN 'C' ELSE 'P' END
      || printf('%.3f', strike + CASE WHEN line % 2 = 0 THEN 0.005e0 ELSE 0.02e0 END),
    CASE n % 3 WHEN 0 THEN underlying_symbol WHEN 1 THEN 'SPAXX**' ELSE 'Pending activity' END]) AS sym FROM chain WHERE o % 97 = 0
), positions AS (
  SELECT DISTINCT CASE WHEN sym LIKE ' -%' THEN 'option' ELSE 'stock' END AS kind, CASE WHEN sym LIKE ' -%' THEN regexp_extract(sym, '-([A-Z.]+)', 1) ELSE sym END AS ticker,
    CASE WHEN sym LIKE ' -%' THEN CAST(strptime('20' || regexp_extract(sym, '([0-9]{6})[CP]', 1), '%Y%m%d') AS DATE) END AS expiration_date,
    CASE WHEN sym LIKE ' -%' THEN CASE regexp_extract(sym, '[0-9]([CP])', 1) WHEN 'C' THEN 'call' ELSE 'put' END END AS option_type,
    CASE WHEN sym LIKE ' -%' THEN CAST(regexp_extract(sym, '[CP]([0-9.]+)$', 1) AS DOUBLE) END AS strike
  FROM symbols WHERE sym NOT IN ('SPAXX**', 'Pending activity')
)"""
#: Positions of every contract, where POSITIONS has those of a portfolio.
ALL_POSITIONS = POSITIONS.replace(" FROM chain WHERE o % 97 = 0", " FROM chain")
HELD = "EXISTS (SELECT 1 FROM positions p WHERE p.kind = 'option' AND p.ticker = c.underlying_symbol AND p.expiration_date = c.expiration_date AND p.option_type = c.option_type AND abs(p.strike - c.strike) < 0.01e0)"
BAND = "c.strike BETWEEN c.underlying_price * (1e0 - 0.35e0) AND c.underlying_price * (1e0 + 0.35e0)"
FILTERED = ROWS + POSITIONS + f", kept AS (SELECT * FROM enriched c WHERE {HELD} OR ({BAND} AND (bid IS NULL OR bid <> 0) AND coalesce(bid_ask_spread_pct_of_mid <= 0.25e0, false)))"


def shown(column: str, source: str | None = None) -> str:
    """A column as every query returns it: doubles of six places, dates and times as text, whole numbers as BIGINT."""
    x = source or column
    if column in STRINGS or column in BOOLEANS:
        return f"{x} AS {column}"
    if column in DATES:
        return f"strftime({x}, '%Y-%m-%d') AS {column}"
    if column in TIMESTAMPS or column.endswith("_timestamp"):
        return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {column}"
    if column in INTEGERS or column in ("volume", "open_interest"):
        return f"CAST({x} AS BIGINT) AS {column}"
    return f"round({x}, 6) AS {column}"


def pick(columns: str, source: str, cte: str = ROWS) -> str:
    return f"WITH {cte.lstrip(', ')} SELECT {', '.join(shown(c) for c in columns.split())} FROM {source}"


def nudged(sql: str) -> str:
    """The same SQL with NUDGE inside every round(..., 6)."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end = 1, found + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = nudged(sql[found + len("round(") : end - 1])
        value, _, places = inner.rpartition(", ")
        out.append(sql[at:found] + (f"round(({value}) + 1e-10, 6)" if places == "6" else f"round({inner})"))
        at = end
    return "".join(out) + sql[at:]


CANONICAL = list(COLUMNS)
