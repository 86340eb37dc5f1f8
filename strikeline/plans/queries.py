"""Every registered query: an operator over the given tables, and the SQL of the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.operators import attach, export, filters, greeks, groups, ledger, positions, pricing, quotes, screens, summaries, validation
from strikeline.functions.sqlx import d
from strikeline.params import Params
from strikeline.plans import enrich, oracle, tables
from strikeline.sources import vendors

PARAMS = Params()
#: The events table's own time.
EVENT_PARAMS = Params(as_of=dt.datetime(2024, 1, 3, 15, 0, 0, tzinfo=dt.timezone.utc))
PER_UNDERLYING = "underlying_symbol option_type"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def shown(df: DataFrame, columns: str | None = None) -> DataFrame:
    """Doubles of six places, dates and times as text, whole numbers as bigint."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> str:
        kind = kinds[c]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return f"rint((`{c}` + {d(oracle.NUDGE)}) * 1e6D) / 1e6D + 0D"  # round() goes through decimals, some ten times as slow
        if isinstance(kind, T.DateType):
            return f"date_format(`{c}`, 'yyyy-MM-dd')"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format(`{c}`, 'yyyy-MM-dd HH:mm:ss')"
        return f"bigint(`{c}`)" if isinstance(kind, (T.IntegerType, T.ShortType)) else f"`{c}`"

    return df.selectExpr(*(f"{text(c)} AS `{c}`" for c in (columns.split() if columns else df.columns)))


def query(name: str, sql: str | None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def row_query(name: str, columns: str) -> None:
    """A query of some columns of the enriched chain; Catalyst prunes the rest."""
    columns = f"contract_symbol {columns}"
    QUERIES[name] = lambda spark, sf: shown(enrich.enrich_rows(tables.chain(spark, sf), PARAMS, settled=False, columns=columns.split()), columns)
    ORACLE[name] = oracle.pick(columns, "enriched")


row_query("quote_quality", "has_valid_underlying has_valid_strike bid_le_ask has_nonzero_bid has_nonzero_ask has_crossed_or_locked_market has_valid_quote has_valid_iv mark_price_mid bid_ask_spread bid_ask_spread_pct_of_mid spread_to_strike_pct spread_to_bid_pct oi_to_volume_ratio")
row_query("moneyness", "strike_minus_spot strike_vs_spot_pct strike_distance_pct itm_amount otm_pct intrinsic_value")
row_query("premium_metrics", "extrinsic_value_bid extrinsic_value_mid extrinsic_value_ask extrinsic_pct_mid has_negative_extrinsic_mid premium_reference_price premium_reference_method premium_to_strike premium_to_strike_bid premium_to_strike_annualized expected_fill_price premium_per_day iv_adjusted_premium_per_day")
row_query("margin_metrics", "estimated_margin_requirement return_on_margin return_on_margin_annualized")
row_query("theta_capital", "theta_to_premium_ratio theta_dollars_per_day capital_required theta_efficiency vega_per_day break_even_if_short")
row_query("greeks", "delta probability_itm gamma vega theta delta_abs delta_safety_pct delta_itm_proxy has_valid_greeks")
row_query("freshness_flags", "quote_age_seconds is_stale_quote")
row_query("tier_scores", "days_bucket near_expiry_near_money_flag spread_score dte_score")
row_query("risk_flags", "risk_level risk_model_inconsistent")
row_query("primary_screen", "is_wide_market passes_primary_screen")
row_query("quote_quality_score", "quote_quality_score")
row_query("option_score", "option_score score_validation score_adjustment final_score")
row_query("event_risk", "earnings_within_5d earnings_within_10d ex_div_within_3d event_risk_score")

_SCAN = "underlying_symbol contract_symbol option_type expiration_date days_to_expiration strike underlying_price underlying_price_time bid ask last_trade_price volume open_interest implied_volatility option_quote_time data_source"


@query("scan_chain", oracle.pick(_SCAN, "chain", oracle.CHAIN))
def scan_chain(spark, sf):
    return shown(tables.chain(spark, sf), _SCAN)


# --- sources -----------------------------------------------------------------------------------------------------------------

_FLAT = "contract_symbol underlying_symbol option_type expiration_date days_to_expiration strike bid ask last_trade_price volume open_interest implied_volatility option_quote_time data_source risk_free_rate_used"


@query("normalize_flat", oracle.pick(_FLAT, "(SELECT * REPLACE (CASE WHEN line = 3 THEN NULL ELSE bid END AS bid) FROM chain)", oracle.CHAIN))
def normalize_flat(spark, sf):
    """Vendor names and text values, some of them no numbers."""
    c = tables.chain(spark, sf)
    raw = c.select(
        F.col("contract_symbol").alias("contractSymbol"), "underlying_symbol", "option_type", F.col("expiration_date").cast("string").alias("expiration_date"), F.col("option_quote_time").cast("string").alias("lastTradeDate"),
        F.col("strike").cast("string").alias("strike"), F.when(F.col("_line") == 3, "n/a").otherwise(F.col("bid").cast("string")).alias("bid"), "ask", F.col("last_trade_price").alias("lastPrice"),
        "volume", F.col("open_interest").alias("openInterest"), F.col("implied_volatility").alias("impliedVolatility"),
    )
    out = vendors.normalize_flat(raw, PARAMS, data_source="tpch")
    return shown(out.withColumns({k: F.col(k).cast("bigint") for k in ("volume", "open_interest")}), _FLAT)


_NESTED = "contract_symbol underlying_symbol option_type expiration_date strike underlying_price bid ask last_trade_price option_quote_time is_in_the_money contract_size delta days_to_expiration"


@query(
    "normalize_nested",
    "WITH " + oracle.CHAIN + f""", x AS (
  SELECT * REPLACE (coalesce(last_trade_price, 7e0) AS last_trade_price), CASE option_type WHEN 'call' THEN underlying_price > strike ELSE strike > underlying_price END AS is_in_the_money,
    'REGULAR' AS contract_size, CASE WHEN line = 2 THEN 0.5e0 END AS delta FROM chain WHERE line <> 5
) SELECT {", ".join(oracle.shown(c) for c in _NESTED.split())} FROM x""",
)
def normalize_nested(spark, sf):
    """Structs with some fields in their second place, and contracts of an unknown type."""
    c = tables.chain(spark, sf)
    odd = F.col("_line") % 2 == 1
    pair = lambda a, b, x: (F.when(odd, x).alias(a), F.when(~odd, x).alias(b))
    micros = F.unix_micros("option_quote_time").cast("string")
    none = F.lit(None)
    raw = c.select(
        F.struct(F.concat(F.lit("O:"), "contract_symbol").alias("ticker"), F.when(F.col("_line") == 5, "other").otherwise(F.upper("option_type")).alias("contract_type"), F.col("expiration_date").cast("string").alias("expiration_date"), F.col("strike").alias("strike_price"), none.cast("string").alias("shares_per_contract")).alias("details"),
        F.struct(*pair("bid", "bid_price", F.col("bid")), *pair("ask", "ask_price", F.col("ask")), *pair("last_updated", "sip_timestamp", micros)).alias("last_quote"),
        F.struct(F.col("last_trade_price").alias("price"), none.cast("string").alias("sip_timestamp")).alias("last_trade"),
        F.struct(*(none.cast("double").alias(k) for k in ("change", "change_percent", "volume")), F.lit(7.0).alias("close"), none.cast("double").alias("previous_close"), none.cast("string").alias("last_updated")).alias("day"),
        F.struct(F.when(F.col("_line") == 2, 0.5).alias("delta"), *(none.cast("double").alias(k) for k in ("gamma", "theta", "vega"))).alias("greeks"), "implied_volatility", F.col("open_interest").cast("double").alias("open_interest"),
        F.struct(F.col("underlying_symbol").alias("ticker"), *pair("price", "value", F.col("underlying_price")), none.cast("string").alias("last_updated")).alias("underlying_asset"),
    )
    return shown(vendors.normalize_nested(raw, PARAMS), _NESTED)


_ARRAYS = "contract_symbol underlying_symbol option_type expiration_date strike bid ask last_trade_price option_quote_time implied_volatility"


@query("normalize_arrays", oracle.pick(_ARRAYS, "chain", oracle.CHAIN))
def normalize_arrays(spark, sf):
    """Parallel arrays, some hundred contracts to a row."""
    c = tables.chain(spark, sf)
    fields = {"optionSymbol": "contract_symbol", "underlying": "underlying_symbol", "side": "option_type", "strike": "strike", "bid": "bid", "ask": "ask", "last": "last_trade_price", "iv": "implied_volatility", "expiration": "_exp", "updated": "_upd"}
    noon = F.unix_seconds(F.col("expiration_date").cast("timestamp")) + 18 * 3600
    rows = c.withColumns({"_exp": noon, "_upd": F.unix_seconds("option_quote_time")})
    packed = rows.groupBy(F.pmod(F.xxhash64("contract_symbol"), F.lit(1 << 20)).alias("part"), "underlying_symbol").agg(F.collect_list(F.struct(*sorted(set(fields.values())))).alias("r"))
    return shown(vendors.normalize_arrays(packed.select(*(F.col(f"r.{v}").alias(k) for k, v in fields.items())), PARAMS), _ARRAYS)


@query(
    "epoch_normalize",
    "SELECT event_id, strftime(make_timestamp(1000000 * (1700000000 + event_id)), '%Y-%m-%d %H:%M:%S') AS time, CAST(4 AS BIGINT) AS n_equal FROM events",
)
def epoch_normalize(spark, sf):
    """One moment in four units."""
    s = F.lit(1700000000).cast("bigint") + F.col("event_id")
    times = [vendors.epoch_or_text(s * k) for k in (1, 1000, 1000000)] + [vendors.epoch_or_text(F.concat(s.cast("string"), F.lit("000000000")))]
    e = tables.table(spark, sf, "events").select("event_id", F.array(*times).alias("t"))
    return shown(e.select("event_id", F.col("t")[0].alias("time"), F.size(F.filter("t", lambda x: x == F.col("t")[0])).alias("n_equal")))


@query(
    "event_date_parse",
    "SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', make_timestamp(1000000 * (1700000000 + 3600 * event_id)))), '%Y-%m-%d') AS from_epoch, strftime(ts, '%Y-%m-%d') AS from_text, CAST(NULL AS VARCHAR) AS from_junk FROM events",
)
def event_date_parse(spark, sf):
    e = tables.table(spark, sf, "events")
    day = lambda x: vendors.event_date(x, PARAMS.market_zone)
    return shown(e.select("event_id", day(F.lit(1700000000) + 3600 * F.col("event_id")).alias("from_epoch"), day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_text"), day(F.lit("soon")).alias("from_junk")))


@query("itm_flag", "WITH " + oracle.CHAIN + " SELECT contract_symbol, CASE option_type WHEN 'call' THEN underlying_price > strike ELSE underlying_price < strike END AS is_in_the_money FROM chain")
def itm_flag(spark, sf):
    return tables.chain(spark, sf).select("contract_symbol", vendors.in_the_money(F.col("option_type"), F.col("underlying_price"), F.col("strike")).alias("is_in_the_money"))


@query("day_counts", oracle.pick("contract_symbol days_to_expiration time_to_expiration_years", "chain", oracle.CHAIN))
def day_counts(spark, sf):
    c = tables.chain(spark, sf).drop("days_to_expiration", "time_to_expiration_years")
    return shown(vendors.day_counts(c, PARAMS), "contract_symbol days_to_expiration time_to_expiration_years")


_MERGED = "contract_symbol delta gamma delta_abs delta_itm_proxy delta_safety_pct has_valid_greeks"


@query(
    "greeks_merge",
    "WITH " + oracle.ROWS + """, v AS (SELECT *, CASE WHEN line = 2 THEN -0.45e0 ELSE delta END AS dv, CASE WHEN line = 4 THEN 0.01e0 ELSE gamma END AS gv FROM enriched)
SELECT contract_symbol, round(dv, 6) AS delta, round(gv, 6) AS gamma, round(abs(dv), 6) AS delta_abs, round(CASE option_type WHEN 'call' THEN dv ELSE abs(dv) END, 6) AS delta_itm_proxy,
  round((1e0 - abs(dv)) * 100e0, 6) AS delta_safety_pct, valid OR dv IS NOT NULL AS has_valid_greeks FROM v""",
)
def greeks_merge(spark, sf):
    """Vendor values of some rows before derived ones."""
    c = tables.chain(spark, sf).withColumns({"delta": F.when(F.col("_line") == 2, -0.45), "gamma": F.when(F.col("_line") == 4, 0.01)})
    return shown(greeks.with_greeks(c, PARAMS), _MERGED)


def _quote_arrays(spark, sf):
    """Arrays of quotes, an underlying's in many rows by a hash of the contract; the last underlyings have no price in them."""
    value = F.struct(
        F.col("contract_symbol").alias("k"), F.when((F.col("_line") != 1) & (F.col("_n") <= 20), F.col("last_trade_price")).alias("last"), F.when(F.col("_line") != 2, F.unix_seconds("option_quote_time")).alias("updated"),
        F.col("underlying_day_change_pct").alias("changepct"),
    )
    rows = tables.chain(spark, sf).groupBy("underlying_symbol", F.pmod(F.xxhash64("contract_symbol"), F.lit(1 << 20)).alias("part")).agg(F.array_sort(F.collect_list(value)).alias("q"))
    return rows.select("underlying_symbol", F.col("q.k").alias("key"), *(F.col(f"q.{k}").alias(k) for k in ("last", "updated", "changepct")))


_BEST = """, qa AS (
  SELECT underlying_symbol, underlying_day_change_pct AS ch, CASE WHEN line <> 1 AND n <= 20 THEN last_trade_price END AS last, CASE WHEN line <> 2 THEN CAST(floor(epoch(option_quote_time)) AS BIGINT) END AS upd,
    row_number() OVER (PARTITION BY underlying_symbol ORDER BY contract_symbol) AS pos FROM chain
), qb AS (
  SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY upd DESC NULLS LAST, pos) AS k FROM qa WHERE last IS NOT NULL
)"""


@query(
    "best_quote_row",
    "WITH " + oracle.CHAIN + _BEST + " SELECT underlying_symbol, round(last, 6) AS underlying_price, strftime(make_timestamp(1000000 * upd), '%Y-%m-%d %H:%M:%S') AS underlying_price_time, round(ch, 6) AS underlying_day_change_pct FROM qb WHERE k = 1",
)
def best_quote_row(spark, sf):
    return shown(vendors.best_quote_row(_quote_arrays(spark, sf)))


@query(
    "underlying_snapshot",
    "WITH " + oracle.CHAIN + _BEST + """, last_row AS (
  SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY option_quote_time DESC NULLS LAST, contract_symbol DESC) AS k FROM chain
) SELECT c.underlying_symbol, round(coalesce(b.last, c.underlying_price), 6) AS underlying_price,
  CASE WHEN b.last IS NOT NULL THEN strftime(make_timestamp(1000000 * b.upd), '%Y-%m-%d %H:%M:%S') ELSE strftime(c.option_quote_time, '%Y-%m-%d %H:%M:%S') END AS underlying_price_time, round(b.ch, 6) AS underlying_day_change_pct
FROM last_row c LEFT JOIN (SELECT * FROM qb WHERE k = 1) b ON c.underlying_symbol = b.underlying_symbol WHERE c.k = 1""",
)
def underlying_snapshot(spark, sf):
    return shown(vendors.underlying_snapshot(_quote_arrays(spark, sf), tables.chain(spark, sf)))


@query(
    "next_event",
    "WITH " + oracle.CHAIN + """, ev AS (
  SELECT underlying_symbol, CASE o % 4 WHEN 0 THEN 'earnings_info' WHEN 1 THEN 'earnings_calendar' WHEN 2 THEN 'dividend' ELSE 'dividend_info' END AS kind,
    CAST(DATE '2002-01-02' + CAST(o % 60 AS INTEGER) - 20 AS DATE) AS event, o % 8 = 0 AS est, line / 10e0 AS amount, contract_symbol AS seq FROM chain
), live AS (SELECT * FROM ev WHERE event >= DATE '2002-01-02'),
e AS (SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY event, CASE kind WHEN 'earnings_info' THEN 0 ELSE 1 END, seq) AS k FROM live WHERE kind LIKE 'earnings%'),
d AS (SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY event, CASE kind WHEN 'dividend' THEN 0 ELSE 1 END, seq) AS k FROM live WHERE kind LIKE 'dividend%')
SELECT coalesce(e.underlying_symbol, d.underlying_symbol) AS underlying_symbol, strftime(e.event, '%Y-%m-%d') AS next_earnings_date, CASE WHEN e.kind = 'earnings_info' THEN e.est END AS next_earnings_date_is_estimated,
  strftime(d.event, '%Y-%m-%d') AS next_ex_div_date, round(CASE WHEN d.kind = 'dividend' THEN d.amount END, 6) AS dividend_amount
FROM (SELECT * FROM e WHERE k = 1) e FULL JOIN (SELECT * FROM d WHERE k = 1) d ON e.underlying_symbol = d.underlying_symbol""",
)
def next_event(spark, sf):
    c = tables.chain(spark, sf)
    kinds = F.array(*(F.lit(k) for k in ("earnings_info", "earnings_calendar", "dividend", "dividend_info")))
    events = c.select("underlying_symbol", kinds[(F.col("_order") % 4).cast("int")].alias("kind"), F.date_add(F.lit(PARAMS.today), (F.col("_order") % 60 - 20).cast("int")).alias("event"), (F.col("_order") % 8 == 0).alias("is_estimated"), (F.col("_line") / 10.0).alias("amount"), F.col("contract_symbol").alias("seq"))
    return shown(vendors.next_events(events, PARAMS))


@query("distinct_expirations", "WITH " + oracle.CHAIN + " SELECT DISTINCT underlying_symbol, strftime(expiration_date, '%Y-%m-%d') AS expiration_date FROM chain")
def distinct_expirations(spark, sf):
    return shown(vendors.distinct_expirations(tables.chain(spark, sf)))


@query("union_sides", "WITH " + oracle.CHAIN + " SELECT contract_symbol, option_type, round(CASE option_type WHEN 'call' THEN bid END, 6) AS bid FROM chain")
def union_sides(spark, sf):
    c = tables.chain(spark, sf).select("contract_symbol", "option_type", "bid")
    return shown(export.union_frames(c.where("option_type = 'call'"), c.where("option_type = 'put'").drop("bid")))


@query(
    "historical_volatility",
    """WITH closes AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2),
r AS (SELECT symbol, d, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY d)) AS r FROM closes),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM r WHERE r IS NOT NULL)
SELECT symbol, round(CASE WHEN count(*) >= 30 THEN stddev_samp(r) * sqrt(252) END, 6) AS historical_volatility FROM k WHERE k <= 30 GROUP BY symbol""",
)
def historical_volatility(spark, sf):
    return shown(groups.historical_volatility(tables.closes(spark, sf), PARAMS))


# --- positions ---------------------------------------------------------------------------------------------------------------


def _positions(spark, sf):
    return positions.parse_positions(tables.raw_positions(spark, sf))


@query("positions_parse", "WITH " + oracle.CHAIN + oracle.ALL_POSITIONS + " SELECT kind, ticker, strftime(expiration_date, '%Y-%m-%d') AS expiration_date, option_type, round(strike, 6) AS strike FROM positions")
def positions_parse(spark, sf):
    """Every contract of the chain as a position's symbol."""
    return shown(positions.parse_positions(tables.raw_positions(spark, sf, every=True)))


@query(
    "ticker_universe",
    "WITH " + oracle.CHAIN + oracle.ALL_POSITIONS + """, configured AS (SELECT DISTINCT underlying_symbol AS ticker FROM chain WHERE n <= 10)
SELECT ticker, false AS is_added FROM configured UNION ALL SELECT DISTINCT ticker, true FROM positions WHERE kind = 'stock' AND ticker NOT IN (SELECT ticker FROM configured)""",
)
def ticker_universe(spark, sf):
    every = positions.parse_positions(tables.raw_positions(spark, sf, every=True))
    return positions.ticker_universe(tables.chain(spark, sf).where("_n <= 10").select(F.col("underlying_symbol").alias("ticker")), every)


@query("positions_match", "WITH " + oracle.CHAIN + oracle.POSITIONS + f" SELECT contract_symbol, round(strike, 6) AS strike FROM chain c WHERE {oracle.HELD}")
def positions_match(spark, sf):
    return shown(positions.match_positions(tables.chain(spark, sf), _positions(spark, sf), PARAMS), "contract_symbol strike")


@query(
    "positions_coverage",
    "WITH " + oracle.CHAIN + oracle.POSITIONS + """, found AS (
  SELECT p.*, c.contract_symbol, row_number() OVER (PARTITION BY p.ticker, p.expiration_date, p.option_type, p.strike ORDER BY c.strike, c.contract_symbol) AS k
  FROM positions p LEFT JOIN chain c ON p.ticker = c.underlying_symbol AND p.expiration_date = c.expiration_date AND p.option_type = c.option_type AND abs(p.strike - c.strike) < 0.01e0 WHERE p.kind = 'option'
) SELECT ticker, strftime(expiration_date, '%Y-%m-%d') AS expiration_date, option_type, round(strike, 6) AS strike, contract_symbol IS NOT NULL AS is_found, contract_symbol FROM found WHERE k = 1""",
)
def positions_coverage(spark, sf):
    return shown(positions.position_coverage(_positions(spark, sf), tables.chain(spark, sf), PARAMS))


@query(
    "screen_failures",
    "WITH " + oracle.ROWS + """ SELECT contract_symbol, concat_ws(',', CASE WHEN NOT coalesce(bid >= 0.5e0, false) THEN 'filters_min_bid' END,
  CASE WHEN NOT coalesce(bid_ask_spread_pct_of_mid <= 0.25e0, false) THEN 'filters_max_spread_pct_of_mid' END, CASE WHEN NOT coalesce(open_interest >= 100, false) THEN 'filters_min_open_interest' END,
  CASE WHEN NOT coalesce(volume >= 10, false) THEN 'filters_min_volume' END) AS failed_filters FROM enriched""",
)
def screen_failures(spark, sf):
    rows = positions.with_screen_failures(quotes.with_quote_quality(tables.chain(spark, sf)), Params(min_bid=0.5))
    return rows.select("contract_symbol", F.concat_ws(",", "failed_filters").alias("failed_filters"))


# --- dimensions --------------------------------------------------------------------------------------------------------------

_SNAP = "contract_symbol underlying_price underlying_price_time underlying_day_change_pct historical_volatility underlying_price_age_seconds is_stale_underlying_price"


@query("attach_snapshot", oracle.pick(_SNAP, "chain WHERE n <> 4", oracle.CHAIN))
def attach_snapshot(spark, sf):
    c = tables.chain(spark, sf).drop("underlying_price_age_seconds", "is_stale_underlying_price")
    dim = tables.underlyings(spark, sf).withColumn("underlying_price", F.when(F.col("underlying_symbol") != "TKD", F.col("underlying_price")))
    return shown(attach.attach_snapshot(c, dim, PARAMS), _SNAP)


_EVENTS = "contract_symbol next_earnings_date next_earnings_date_is_estimated days_to_earnings next_ex_div_date days_to_ex_div dividend_amount"


@query("attach_events", oracle.pick(_EVENTS, "chain", oracle.CHAIN))
def attach_events(spark, sf):
    return shown(attach.attach_events(tables.chain(spark, sf).drop("days_to_earnings", "days_to_ex_div"), tables.underlyings(spark, sf), PARAMS), _EVENTS)


@query(
    "expiration_window",
    "WITH " + oracle.CHAIN + oracle.POSITIONS + """ SELECT contract_symbol, strftime(expiration_date, '%Y-%m-%d') AS expiration_date FROM chain
WHERE expiration_date <= DATE '2002-01-02' + 70 AND days_to_expiration >= CASE WHEN underlying_symbol IN (SELECT ticker FROM positions WHERE kind = 'stock') THEN 0 ELSE 1 END""",
)
def expiration_window(spark, sf):
    return shown(attach.select_expirations(tables.chain(spark, sf), _positions(spark, sf), Params(max_expiration_weeks=10)), "contract_symbol expiration_date")


# --- group statistics --------------------------------------------------------------------------------------------------------


def _rows(spark, sf, settled: bool = False, columns: str | None = None):
    """Settled where a filter or an order reads Greeks or scores; without, what a query does not read is not computed. Of all columns, or of those named and those of
    the chain."""
    chain = tables.chain(spark, sf)
    return enrich.enrich_rows(chain, PARAMS, settled, None if columns is None else [*chain.columns, *columns.split()])


def _group_query(name: str, fn, columns: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: shown(fn(_rows(spark, sf, columns="strike_distance_pct theta_efficiency premium_reference_price")), f"contract_symbol {columns}")
    ORACLE[name] = "WITH " + sql


_group_query("iv_state_level", groups.with_iv_state_level, "iv_state_level", oracle.LEVEL + " SELECT contract_symbol, iv_state_level FROM enriched JOIN levels USING (underlying_symbol)")
_group_query("iv_state_term", groups.with_iv_state_term, "iv_state_term", oracle.ROWS + oracle.TERM + " SELECT contract_symbol, coalesce(iv_state_term, 'UNKNOWN') AS iv_state_term FROM enriched LEFT JOIN terms USING (underlying_symbol)")
_group_query("strike_increment", groups.with_strike_increment, "listed_strike_increment", oracle.ROWS + oracle.STEP + " SELECT contract_symbol, round(listed_strike_increment, 6) AS listed_strike_increment FROM enriched LEFT JOIN increments USING (underlying_symbol, option_type)")
_group_query("theta_below_p25", groups.with_theta_below_p25, "theta_efficiency_below_p25", oracle.ROWS + oracle.QUARTILE.format(source="enriched") + " SELECT contract_symbol, theta_efficiency < p25 AS theta_efficiency_below_p25 FROM enriched JOIN quartiles USING (underlying_symbol, option_type)")
_MOVES = "round(move, 6) AS expected_move, round(move / s, 6) AS expected_move_pct, round(s - move, 6) AS expected_move_lower_bound, round(s + move, 6) AS expected_move_upper_bound"
_group_query("expected_move", groups.with_expected_move, "expected_move expected_move_pct expected_move_lower_bound expected_move_upper_bound", oracle.ROWS + oracle.MOVE.format(source="enriched") + f" SELECT contract_symbol, {_MOVES} FROM enriched LEFT JOIN moves USING (underlying_symbol, expiration_date)")
_group_query(
    "roll_yield", groups.with_roll_yield, "roll_days_added roll_net_credit roll_yield",
    oracle.ROWS + """, rolled AS (SELECT *, lag(days_to_expiration) OVER w AS d0, lag(premium_reference_price) OVER w AS p0 FROM enriched
  WINDOW w AS (PARTITION BY underlying_symbol, option_type, strike ORDER BY days_to_expiration, expiration_date, contract_symbol))
SELECT contract_symbol, CASE WHEN p0 IS NOT NULL AND days_to_expiration > d0 THEN days_to_expiration - d0 END AS roll_days_added, round(CASE WHEN days_to_expiration > d0 THEN premium_reference_price - p0 END, 6) AS roll_net_credit,
  round(CASE WHEN days_to_expiration > d0 THEN (premium_reference_price - p0) / (days_to_expiration - d0) END, 6) AS roll_yield FROM rolled""",
)


# --- filters -----------------------------------------------------------------------------------------------------------------


def _filter_query(name: str, test: str, column) -> None:
    QUERIES[name] = lambda spark, sf: shown(_rows(spark, sf, columns="bid_ask_spread_pct_of_mid").where(column()), "contract_symbol bid strike bid_ask_spread_pct_of_mid")
    ORACLE[name] = oracle.pick("contract_symbol bid strike bid_ask_spread_pct_of_mid", f"enriched c WHERE {test}")


_filter_query("filter_strike_band", oracle.BAND, lambda: filters.in_strike_band(PARAMS))
_filter_query("filter_zero_bid", "bid IS NULL OR bid <> 0", filters.has_bid)
_filter_query("filter_wide_spread", "bid_ask_spread_pct_of_mid <= 0.25e0", lambda: filters.is_tight(PARAMS))
ORACLE["table_range_filter"] = oracle.pick("contract_symbol bid strike bid_ask_spread_pct_of_mid", "enriched c WHERE c.strike BETWEEN 20 AND 120")


@query("table_range_filter", ORACLE["table_range_filter"])
def table_range_filter(spark, sf):
    return shown(filters.range_filter(_rows(spark, sf, columns="bid_ask_spread_pct_of_mid"), "strike", 20, 120), "contract_symbol bid strike bid_ask_spread_pct_of_mid")


@query("filter_with_bypass", oracle.pick("contract_symbol strike bid", "kept", oracle.FILTERED))
def filter_with_bypass(spark, sf):
    return shown(filters.filter_chain(_rows(spark, sf, columns="bid_ask_spread_pct_of_mid"), PARAMS, _positions(spark, sf)), "contract_symbol strike bid")


@query("filter_accounting", "WITH " + oracle.FILTERED + """ SELECT underlying_symbol, count(*) AS raw_rows, coalesce(max(k), 0) AS kept_rows, count(*) - coalesce(max(k), 0) AS dropped_rows
FROM enriched LEFT JOIN (SELECT underlying_symbol, count(*) AS k FROM kept GROUP BY 1) x USING (underlying_symbol) GROUP BY 1""")
def filter_accounting(spark, sf):
    rows = _rows(spark, sf, columns="bid_ask_spread_pct_of_mid")
    return filters.filter_accounting(rows, filters.filter_chain(rows, PARAMS, _positions(spark, sf)))


@query("table_value_filter", "WITH " + oracle.ROWS + " SELECT contract_symbol, coalesce(score_validation, '—') AS label FROM enriched WHERE coalesce(score_validation, '—') IN ('—', 'DISCREPANCY')")
def table_value_filter(spark, sf):
    return filters.value_filter(_rows(spark, sf, True, "score_validation"), "score_validation", ["—", "DISCREPANCY"]).select("contract_symbol", filters.label("score_validation").alias("label"))


@query("facet_values", "WITH " + oracle.ROWS + " SELECT DISTINCT coalesce(score_validation, '—') AS label FROM enriched")
def facet_values(spark, sf):
    return filters.facet_values(_rows(spark, sf, columns="score_validation"), "score_validation")


# --- validation and export ---------------------------------------------------------------------------------------------------


def _raw_text(spark, sf):
    """Pre-cast text with breaches planted by order number."""
    c = tables.chain(spark, sf)
    when = lambda k, bad, name: F.when(F.col("_order") % 53 == k, F.lit(bad)).otherwise(F.col(name).cast("string")).alias(name)
    return c.select(
        "contract_symbol", "data_source", when(1, " ", "underlying_symbol"), when(2, "straddle", "option_type"), when(3, "2002-13-40", "expiration_date"), when(4, "-5", "strike"), when(5, "0", "underlying_price"),
        when(6, "-1", "bid"), when(7, "abc", "ask"), F.col("last_trade_price").cast("string").alias("last_trade_price"), F.lit("2002-01-02 20:00:00").alias("underlying_price_time"), when(8, "noon", "option_quote_time"),
        F.when(F.col("_order") % 53 == 9, "maybe").otherwise("true").alias("is_in_the_money"),
    )


_FINDINGS = oracle.CHAIN + """, f AS (
  SELECT contract_symbol, unnest(list_filter([
    CASE WHEN o % 53 = 1 THEN 'error|missing_required_field|underlying_symbol' END, CASE WHEN o % 53 <> 6 AND bid IS NULL THEN 'error|missing_required_field|bid' END,
    CASE WHEN o % 53 = 2 THEN 'error|invalid_option_type|option_type' END, CASE WHEN o % 53 = 3 THEN 'error|invalid_expiration_date|expiration_date' END, CASE WHEN o % 53 = 7 THEN 'error|invalid_numeric_field|ask' END,
    CASE WHEN o % 53 = 8 THEN 'error|invalid_timestamp_field|option_quote_time' END, CASE WHEN o % 53 = 9 THEN 'warning|invalid_boolean_field|is_in_the_money' END, CASE WHEN o % 53 = 4 THEN 'error|invalid_strike|strike' END,
    CASE WHEN o % 53 = 5 THEN 'error|invalid_underlying_price|underlying_price' END, CASE WHEN o % 53 = 6 THEN 'error|invalid_bid|bid' END, CASE WHEN ask < 0 AND o % 53 <> 7 THEN 'error|invalid_ask|ask' END,
    CASE WHEN o % 53 <> 7 AND CASE WHEN o % 53 = 6 THEN -1e0 ELSE bid END > ask THEN 'error|invalid_quote_order|bid_ask' END], lambda x: x IS NOT NULL)) AS t FROM chain
), findings AS (SELECT contract_symbol, split_part(t, '|', 1) AS severity, split_part(t, '|', 2) AS code, split_part(t, '|', 3) AS field FROM f)"""


@query("validate_rows", "WITH " + _FINDINGS + " SELECT * FROM findings")
def validate_rows(spark, sf):
    return validation.row_findings(_raw_text(spark, sf)).select("contract_symbol", "severity", "code", "field")


@query("validation_summary", "WITH " + _FINDINGS + " SELECT severity, code, count(*) AS n_findings, min(contract_symbol) AS sample_contract FROM findings GROUP BY 1, 2")
def validation_summary(spark, sf):
    return validation.summarize(validation.row_findings(_raw_text(spark, sf)))


@query("validate_sources", "SELECT 'error' AS severity, 'mixed_data_sources' AS code, 'data_source' AS field, 'rows of more than one source' AS message FROM lineitem HAVING count(DISTINCT l_returnflag) > 1")
def validate_sources(spark, sf):
    return validation.mixed_sources(tables.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("data_source")))


@query("validate_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def validate_duplicates(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return validation.duplicate_contracts(rows, ("l_orderkey", "l_linenumber"))


_EXPORTED = oracle.FILTERED + oracle.LEVEL.removeprefix(oracle.ROWS) + oracle.TERM + oracle.STEP + oracle.QUARTILE.format(source="kept") + oracle.MOVE.format(source="kept")
_SOURCES = {
    "theta_efficiency_below_p25": "theta_efficiency < p25", "expected_move": "round(move, 6)", "expected_move_pct": "round(move / s, 6)", "expected_move_lower_bound": "round(s - move, 6)", "expected_move_upper_bound": "round(s + move, 6)",
    "iv_state_term": "coalesce(iv_state_term, 'UNKNOWN')", "change": "CAST(NULL AS DOUBLE)", "percent_change": "CAST(NULL AS DOUBLE)", "is_in_the_money": "CAST(NULL AS BOOLEAN)", "contract_size": "CAST(NULL AS VARCHAR)",
    "underlying_price_time": "strftime(underlying_price_time, '%Y-%m-%dT%H:%M:%SZ')", "option_quote_time": "strftime(option_quote_time, '%Y-%m-%dT%H:%M:%SZ')", "volume": "CAST(volume AS DOUBLE)", "open_interest": "CAST(open_interest AS DOUBLE)",
}


@query(
    "export_conform",
    "WITH " + _EXPORTED + " SELECT " + ", ".join(f"{_SOURCES[c]} AS {c}" if c in _SOURCES else oracle.shown(c) for c in oracle.CANONICAL)
    + " FROM kept LEFT JOIN levels USING (underlying_symbol) LEFT JOIN terms USING (underlying_symbol) LEFT JOIN increments USING (underlying_symbol, option_type) LEFT JOIN quartiles USING (underlying_symbol, option_type) LEFT JOIN moves USING (underlying_symbol, expiration_date)",
)
def export_conform(spark, sf):
    """The whole plan, from chain to canonical rows."""
    return shown(export.format_timestamps(export.conform(enrich.full_chain(tables.chain(spark, sf), PARAMS, _positions(spark, sf)))))


# --- summaries ---------------------------------------------------------------------------------------------------------------

_TOP = "underlying_symbol contract_symbol option_type expiration_date strike premium_reference_price delta_abs risk_level spread_score quote_quality_score option_score final_score"
_TIES = "option_type, strike, contract_symbol"
_RANKED = " ".join((*summaries.RANKED, "passes_primary_screen"))


def _top(name: str, fn, inner: str, extra: str = "") -> None:
    QUERIES[name] = lambda spark, sf: shown(fn(_rows(spark, sf, True, _RANKED)), _TOP + (" conviction_score" if extra else "") + " return_on_margin_annualized_pct")
    ORACLE[name] = (
        "WITH " + oracle.ROWS + f", ranked AS ({inner}) SELECT {', '.join(oracle.shown(c) for c in _TOP.split())}{extra}, round(round(return_on_margin_annualized * 100e0, 1), 6) AS return_on_margin_annualized_pct FROM ranked WHERE k = 1"
    )


_top("top_profitable", summaries.top_profitable, f"SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY return_on_margin_annualized DESC NULLS LAST, coalesce(final_score, option_score, 0) DESC, quote_quality_score DESC, {_TIES}) AS k FROM enriched WHERE passes_primary_screen")
_MODERATE = f"""SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY tier, coalesce(final_score, option_score, 0) DESC, return_on_margin_annualized DESC NULLS LAST, delta_abs, {_TIES}) AS k FROM (
  SELECT *, CASE WHEN delta_abs <= 0.4e0 AND bid_ask_spread_pct_of_mid <= 0.25e0 THEN 1 WHEN delta_abs <= 0.45e0 THEN 2 END AS tier FROM enriched WHERE passes_primary_screen) WHERE tier IS NOT NULL"""
_top("top_moderate", lambda c: summaries.top_moderate(c, PARAMS), _MODERATE)
_top(
    "top_conviction", summaries.top_conviction,
    f"""SELECT *, row_number() OVER (PARTITION BY underlying_symbol, option_type ORDER BY conviction DESC, coalesce(final_score, 0) DESC, quote_quality_score DESC, spread_score DESC, strike_distance_pct, {_TIES}) AS k FROM (
  SELECT *, round(coalesce(final_score, 0e0) + quote_quality_score * 2e0 + spread_score * 0.5e0 + underlying_day_change_pct * CASE option_type WHEN 'call' THEN 300e0 ELSE -300e0 END - strike_distance_pct * 100e0
    - coalesce(abs(delta_abs - CASE option_type WHEN 'call' THEN 0.4e0 ELSE 0.35e0 END), 1e0) * 40e0 + coalesce(return_on_margin_annualized, 0e0) * 5e0, 9) AS conviction FROM enriched WHERE passes_primary_screen)""",
    ", round(conviction, 6) AS conviction_score",
)

_SUMMARY = """, s AS (
  SELECT underlying_symbol, count(*) AS row_count, count(*) FILTER (option_type = 'call') AS call_count, count(*) FILTER (option_type = 'put') AS put_count, count(DISTINCT expiration_date) AS expiration_count,
    max(underlying_price) AS price, max(underlying_day_change_pct) AS ch, round(median(implied_volatility) * 100e0, 1) AS iv, round(max(historical_volatility) * 100e0, 1) AS hv,
    strftime(max(next_earnings_date), '%Y-%m-%d') AS next_earnings_date, bool_or(next_earnings_date_is_estimated) AS est, arg_min(event_risk_score, contract_symbol) FILTER (event_risk_score IS NOT NULL) AS risk FROM enriched GROUP BY 1
)"""


@query(
    "ticker_summary",
    "WITH " + oracle.ROWS + _SUMMARY + """ SELECT underlying_symbol, row_count, call_count, put_count, expiration_count, round(price, 6) AS underlying_price, round(ch * 100e0, 1) AS underlying_day_change_pct, iv AS median_implied_volatility_pct,
  hv AS historical_volatility_pct, round(iv / hv, 2) AS iv_hv_ratio, next_earnings_date, est AS next_earnings_date_is_estimated, round(risk, 6) AS event_risk_score FROM s""",
)
def ticker_summary(spark, sf):
    return shown(summaries.ticker_summary(_rows(spark, sf, columns="event_risk_score")).drop("_change"))


@query(
    "ticker_status",
    "WITH " + oracle.ROWS + _SUMMARY + """ SELECT underlying_symbol, CASE WHEN ch * 100e0 > 0.2e0 THEN 'Up ' || printf('%.1f', ch * 100e0) || '%' WHEN ch * 100e0 < -0.2e0 THEN 'Down ' || printf('%.1f', -ch * 100e0) || '%' ELSE 'Flat' END
  || ' · ' || CASE WHEN iv / hv >= 1.15e0 THEN 'IV rich' WHEN iv / hv <= 0.9e0 THEN 'IV soft' ELSE 'IV balanced' END AS latest_status,
  underlying_symbol || ' last underlying price was ' || printf('%.2f', price) || CASE WHEN ch >= 0 THEN ', up ' ELSE ', down ' END || printf('%.1f', abs(ch * 100e0)) || '% versus previous close.' AS market_context FROM s""",
)
def ticker_status(spark, sf):
    return summaries.with_status(summaries.ticker_summary(_rows(spark, sf, columns="event_risk_score"))).select("underlying_symbol", "latest_status", "market_context")


_PROFITABLE = f"SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY return_on_margin_annualized DESC NULLS LAST, coalesce(final_score, option_score, 0) DESC, quote_quality_score DESC, {_TIES}) AS k FROM enriched WHERE passes_primary_screen"


@query(
    "highlights",
    "WITH " + oracle.ROWS + f""", a AS ({_PROFITABLE}), b AS ({_MODERATE}), u AS (
  SELECT 'most_profitable' AS highlight, underlying_symbol, contract_symbol, round(return_on_margin_annualized * 100e0, 1) AS r FROM a WHERE k = 1
  UNION ALL SELECT 'moderate_risk', underlying_symbol, contract_symbol, round(return_on_margin_annualized * 100e0, 1) FROM b WHERE k = 1
) SELECT highlight, underlying_symbol, contract_symbol, r AS return_on_margin_annualized_pct FROM u QUALIFY row_number() OVER (PARTITION BY highlight ORDER BY r DESC NULLS LAST, underlying_symbol) = 1""",
)
def highlights(spark, sf):
    rows = _rows(spark, sf, True, _RANKED)
    return shown(summaries.highlights(summaries.top_profitable(rows), summaries.top_moderate(rows, PARAMS)))


@query(
    "freshness_summary",
    "WITH " + oracle.ROWS + """ SELECT round(median(quote_age_seconds), 6) AS option_quote_age_median_seconds, round(max(quote_age_seconds), 6) AS option_quote_age_max_seconds,
  round(median(underlying_price_age_seconds), 6) AS underlying_quote_age_median_seconds, round(max(underlying_price_age_seconds), 6) AS underlying_quote_age_max_seconds FROM enriched""",
)
def freshness_summary(spark, sf):
    return shown(summaries.freshness_summary(_rows(spark, sf, columns="quote_age_seconds")))


_LATER = Params(as_of=PARAMS.as_of + dt.timedelta(hours=1))
_AGE = "epoch(TIMESTAMP '2002-01-02 22:00:00' - {0})::DOUBLE"


def _fresh(kind: str, ts: str, flag: str) -> str:
    age = _AGE.format(ts)
    return f"SELECT '{kind}' AS kind, count(*) AS rows_with_timestamp, count(*) FILTER ({age} > 10800) AS stale_now_rows, count(*) FILTER ({flag}) AS stale_at_fetch_rows, strftime(max({ts}), '%Y-%m-%d %H:%M:%S') AS newest_timestamp, strftime(min({ts}), '%Y-%m-%d %H:%M:%S') AS oldest_timestamp, min({age}) AS newest_age_seconds, max({age}) AS oldest_age_seconds FROM enriched"


@query("freshness_now", "WITH " + oracle.ROWS + " " + _fresh("quotes", "option_quote_time", "is_stale_quote") + " UNION ALL " + _fresh("underlyings", "underlying_price_time", "is_stale_underlying_price"))
def freshness_now(spark, sf):
    return shown(summaries.freshness_now(_rows(spark, sf, columns="is_stale_quote"), _LATER))


@query(
    "stale_underlyings",
    "WITH " + oracle.CHAIN + f""" SELECT underlying_symbol AS symbol, count(*) AS row_count, count(DISTINCT underlying_price_time) AS distinct_timestamps, strftime(max(underlying_price_time), '%Y-%m-%d %H:%M:%S') AS newest_timestamp,
  strftime(min(underlying_price_time), '%Y-%m-%d %H:%M:%S') AS oldest_timestamp, {_AGE.format("max(underlying_price_time)")} AS newest_age_seconds, {_AGE.format("min(underlying_price_time)")} AS oldest_age_seconds
FROM chain GROUP BY 1 HAVING {_AGE.format("max(underlying_price_time)")} > 10800""",
)
def stale_underlyings(spark, sf):
    return shown(summaries.stale_underlyings(tables.chain(spark, sf), _LATER))


@query("freshness_gate", "WITH " + oracle.CHAIN + f" SELECT underlying_symbol, {_AGE.format('min(underlying_price_time)')} AS oldest_age_seconds, CASE WHEN {_AGE.format('min(underlying_price_time)')} > 86400 THEN 'block' WHEN {_AGE.format('min(underlying_price_time)')} > 10800 THEN 'warn' ELSE 'ok' END AS gate FROM chain GROUP BY 1")
def freshness_gate(spark, sf):
    return shown(summaries.freshness_gate(tables.chain(spark, sf), _LATER))


@query("dataset_constants", "WITH " + oracle.CHAIN + " SELECT 'risk_free_rate_used' AS name, '0.045' AS value FROM chain HAVING count(*) > 0 UNION ALL SELECT 'data_source', max(data_source) FROM chain HAVING count(DISTINCT data_source) = 1")
def dataset_constants(spark, sf):
    return summaries.dataset_constants(_rows(spark, sf, columns="premium_reference_method"))


@query("chain_slice", oracle.pick("contract_symbol option_type strike bid ask", "chain WHERE underlying_symbol = 'TKC' AND expiration_date = DATE '2002-01-23' AND option_type = 'put'", oracle.CHAIN))
def chain_slice(spark, sf):
    return shown(summaries.chain_slice(tables.chain(spark, sf), "TKC", dt.date(2002, 1, 23), "put"), "contract_symbol option_type strike bid ask")


_KEYS = "underlying_symbol, strftime(expiration_date, '%Y-%m-%d') AS expiration_date, option_type"


@query("chain_totals", "WITH " + oracle.ROWS + f" SELECT {_KEYS}, count(*) AS contracts, round(count(*) FILTER (passes_primary_screen) / count(*), 6) AS pass_share, CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(open_interest) AS BIGINT) AS total_open_interest FROM enriched GROUP BY ALL")
def chain_totals(spark, sf):
    return shown(summaries.chain_totals(_rows(spark, sf, columns="passes_primary_screen")))


@query("risk_mix", "WITH " + oracle.ROWS + f" SELECT {_KEYS}, " + ", ".join(f"count(*) FILTER (risk_level = '{x}') AS {x.lower()}_count, round(count(*) FILTER (risk_level = '{x}') / count(*), 6) AS {x.lower()}_share" for x in ("LOW", "MODERATE", "HIGH")) + " FROM enriched GROUP BY ALL")
def risk_mix(spark, sf):
    return shown(summaries.risk_mix(_rows(spark, sf, columns="risk_level")))


@query("liquidity_topk", "WITH " + oracle.CHAIN + f" SELECT {_KEYS}, contract_symbol, open_interest + volume AS liquidity, row_number() OVER w AS rank FROM chain WINDOW w AS (PARTITION BY underlying_symbol, chain.expiration_date, option_type ORDER BY open_interest + volume DESC, strike, contract_symbol) QUALIFY row_number() OVER w <= 6")
def liquidity_topk(spark, sf):
    return shown(summaries.liquidity_topk(tables.chain(spark, sf)), "underlying_symbol expiration_date option_type contract_symbol liquidity rank")


@query("table_sort_page", oracle.pick("contract_symbol final_score", "(SELECT * FROM enriched ORDER BY final_score DESC NULLS LAST, contract_symbol LIMIT 100 OFFSET 100)"))
def table_sort_page(spark, sf):
    return shown(summaries.sort_page(_rows(spark, sf, True, "final_score"), "final_score", 2, 100, descending=True), "contract_symbol final_score")


@query(
    "chart_sample",
    "WITH " + oracle.CHAIN + f""", r AS (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, expiration_date, option_type ORDER BY strike, contract_symbol) - 1 AS rank, count(*) OVER (PARTITION BY underlying_symbol, expiration_date, option_type) AS c FROM chain)
SELECT {_KEYS}, contract_symbol, rank FROM r WHERE c <= 20 OR rank IN (SELECT floor(i / 19e0 * (c - 1) + 0.5e0) FROM range(0, 20) t(i))""",
)
def chart_sample(spark, sf):
    return shown(summaries.even_sample(tables.chain(spark, sf), 20), "underlying_symbol expiration_date option_type contract_symbol rank")


@query("chart_extents", "WITH " + oracle.CHAIN + f" SELECT {_KEYS}, round(min(bid), 6) AS bid_min, round(max(bid), 6) AS bid_max, round(min(implied_volatility), 6) AS implied_volatility_min, round(max(implied_volatility), 6) AS implied_volatility_max FROM chain GROUP BY ALL")
def chart_extents(spark, sf):
    return shown(summaries.extents(tables.chain(spark, sf), ("bid", "implied_volatility")))


# --- ledger ------------------------------------------------------------------------------------------------------------------

_LEDGER = "event_id AS dataset_id, event_type AS provider, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at"


@query("ledger_list", f"SELECT {_LEDGER} FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 50")
def ledger_list(spark, sf):
    day = lambda k: dt.datetime(2024, 1, k, tzinfo=dt.timezone.utc)
    return shown(ledger.list_snapshots(tables.ledger(spark, sf), "click", day(2), day(20)))


@query("ledger_latest", f"SELECT {_LEDGER} FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def ledger_latest(spark, sf):
    return shown(ledger.latest_snapshot(tables.ledger(spark, sf)))


@query("runs_today", "SELECT event_type AS provider, count(*) AS runs FROM events WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) = DATE '2024-01-03' GROUP BY 1")
def runs_today(spark, sf):
    return ledger.runs_today(tables.ledger(spark, sf), EVENT_PARAMS)


@query("retention_candidates", f"SELECT {_LEDGER} FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 100")
def retention_candidates(spark, sf):
    return shown(ledger.retention_candidates(tables.ledger(spark, sf), 100))


from strikeline.plans import contracts, streams  # noqa: E402

contracts.register(query, shown)
streams.register(query, shown)
ORACLE.update({name: oracle.nudged(sql) for name, sql in ORACLE.items()})
