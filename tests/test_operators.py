"""Hand-made cases of the chain's operators."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strikeline.functions import ranks
from strikeline.operators import attach, export, filters, greeks, groups, ledger, positions, pricing, quotes, screens, summaries, validation
from strikeline.params import Params
from strikeline.schema import CHAIN, COLUMNS, SCHEMA_VERSION
from strikeline.sources import vendors

P = Params(as_of=dt.datetime(2026, 3, 20, 16, 0, tzinfo=dt.timezone.utc), max_strike_distance_pct=0.30, stale_quote_seconds=21600, min_bid=0.5)
D = dt.date


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_columns_are_complete_and_typed():
    assert len(COLUMNS) == len(set(COLUMNS)) == len(CHAIN.fields) == 110


def test_quote_quality_and_null_rules(spark):
    df = spark.createDataFrame([(1.0, 1.1), (0.0, 0.2), (None, 1.0), (2.0, 1.0), (1.0, 1.0)], "bid double, ask double")
    df = df.selectExpr("*", "100d AS strike", "0d AS underlying_price", "null::double AS implied_volatility", "0L AS volume", "5L AS open_interest")
    out = rows(quotes.with_quote_quality(df), "has_valid_quote", "has_nonzero_bid", "has_crossed_or_locked_market", "has_valid_underlying", "has_valid_iv", "oi_to_volume_ratio", "mark_price_mid")
    assert [r[:3] for r in out] == [(True, True, False), (True, False, False), (False, False, False), (False, True, True), (True, True, True)]
    assert all(r[3] is False and r[4] is False and r[5] is None for r in out) and out[2][6] is None


def test_call_and_put_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("call",), ("put",)], "option_type string").selectExpr("*", "110d AS underlying_price", "100d AS strike", "0.5d AS time_to_expiration_years", "0.25d AS implied_volatility")
    p = dict(rows(greeks.with_greeks(df, P), "option_type", "probability_itm"))
    assert p["call"] > p["put"] and abs(p["call"] + p["put"] - 1) < 1e-9
    exact = 0.5 * math.erfc(-((math.log(1.1) + (0.045 - 0.03125) * 0.5) / (0.25 * math.sqrt(0.5))) / math.sqrt(2))
    assert abs(p["call"] - exact) < 1e-12
    assert rows(greeks.with_greeks(df.withColumn("time_to_expiration_years", F.lit(0.0)), P), "delta", "has_valid_greeks") == [(None, False)] * 2


def test_vendor_greeks_come_first(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "delta double").selectExpr("*", "'call' AS option_type", "110d AS underlying_price", "100d AS strike", "0.5d AS time_to_expiration_years", "0.25d AS implied_volatility")
    out = rows(greeks.with_greeks(df, P), "delta", "delta_abs")
    assert out[0] == (0.5, 0.5) and out[1][0] > 0.5


@pytest.mark.parametrize("spread,score", [(0.08, 100.0), (0.10, 85.0), (0.15, 85.0), (0.20, 42.5), (0.30, 0.0), (None, 0.0)])
def test_spread_score(spark, spread, score):
    df = spark.createDataFrame([(spread, 14, 0.01)], "bid_ask_spread_pct_of_mid double, days_to_expiration int, strike_distance_pct double")
    assert rows(screens.with_tiers(df), "spread_score", "dte_score", "days_bucket")[0] == (pytest.approx(score), 100.0, "Week_2")


def test_event_risk(spark):
    data = [(30, 3, 2), (30, 8, 6), (30, None, None), (2, 5, 4), (6, 5, 4), (30, 3, None)]
    df = spark.createDataFrame(data, "days_to_expiration int, days_to_earnings int, days_to_ex_div int")
    assert [r[0] for r in rows(screens.with_event_risk(df), "event_risk_score")] == [100.0, 50.0, None, None, 80.0, 60.0]


def test_zero_bid_band_and_spread_keep_or_drop_missing(spark):
    df = spark.createDataFrame([("a", None, 70.0, 0.25), ("b", 0.0, 130.0, None), ("c", 1.0, 131.0, 0.1)], "contract_symbol string, bid double, strike double, bid_ask_spread_pct_of_mid double").withColumn("underlying_price", F.lit(100.0))
    keep = lambda test: [r[0] for r in rows(df.where(test), "contract_symbol")]
    assert keep(filters.has_bid()) == ["a", "c"] and keep(filters.in_strike_band(P)) == ["a", "b"] and keep(filters.is_tight(P)) == ["a", "c"]
    assert filters.filter_chain(df, Params(enable_filters=False)).count() == 3


def test_positions(spark):
    raw = spark.createDataFrame([(" -TSLA260821P360",), (" -UBER260618C82.5",), ("SPAXX**",), ("Pending activity",), ("NVDA",), ("NVDA",), (None,), ("",), ("not a symbol",)], "Symbol string")
    p = positions.parse_positions(raw)
    got = set(rows(p, "kind", "ticker", "expiration_date", "option_type", "strike"))
    assert got == {("option", "TSLA", D(2026, 8, 21), "put", 360.0), ("option", "UBER", D(2026, 6, 18), "call", 82.5), ("stock", "NVDA", None, None, None)}
    assert positions.parse_positions(raw.toDF("other")).count() == 0
    chain = spark.createDataFrame([("TSLA", D(2026, 8, 21), "put", 360.005, "x"), ("TSLA", D(2026, 8, 21), "put", 360.02, "y")], "underlying_symbol string, expiration_date date, option_type string, strike double, contract_symbol string")
    assert [r[0] for r in rows(positions.match_positions(chain, p, P), "contract_symbol")] == ["x"]
    assert {(r[0], r[1]) for r in rows(positions.position_coverage(p, chain, P), "ticker", "is_found")} == {("TSLA", True), ("UBER", False)}


def _chain(spark, data):
    return spark.createDataFrame(data, "underlying_symbol string, option_type string, expiration_date date, strike double, implied_volatility double").selectExpr(
        "*", "DATE '2026-03-20' AS snapshot_date", "concat_ws('-', option_type, strike, expiration_date) AS contract_symbol", "abs(strike - 100) / 100 AS strike_distance_pct"
    )


def test_iv_level_and_term(spark):
    e1, e2 = D(2026, 4, 17), D(2026, 5, 15)
    data = [("H", "call", e1, 100.0, 0.9)] + [("H", "call", e1, 110.0 + k, 0.2 + k / 100) for k in range(5)] + [("H", "call", e2, 100.0, 1.9)]
    data += [("U", "call", e1, 100.0, 0.3), ("U", "call", e1, 110.0, None)]
    c = _chain(spark, data)
    assert dict(rows(groups.with_iv_state_level(c), "underlying_symbol", "iv_state_level")) == {"H": "HIGH", "U": "UNKNOWN"}
    assert dict(rows(groups.with_iv_state_term(c), "underlying_symbol", "iv_state_term")) == {"H": "RISING", "U": "UNKNOWN"}


def test_strike_increment(spark):
    e1, e2 = D(2026, 4, 17), D(2026, 5, 15)
    data = [("A", "call", e1, x, 0.2) for x in (90.0, 100.0)] + [("A", "call", e2, x, 0.2) for x in (90.0, 95.0, 100.0, 102.5)] + [("A", "put", e1, x, 0.2) for x in (90.0, 90.0, 95.0)]
    assert dict(rows(groups.with_strike_increment(_chain(spark, data)), "option_type", "listed_strike_increment")) == {"call": 2.5, "put": None}


def test_expected_move(spark):
    data = [("A", "call", D(2026, 6, 19), 100.0, 0.30), ("A", "put", D(2026, 6, 19), 100.0, 0.40), ("A", "put", D(2026, 6, 19), 120.0, 0.9)]
    c = _chain(spark, data).selectExpr("*", "100d AS underlying_price", "0.25d AS time_to_expiration_years")
    assert {round(r[0], 9) for r in rows(groups.with_expected_move(c), "expected_move")} == {17.5}


def test_theta_quartile(spark):
    c = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("A", 4.0), ("B", 5.0), ("B", 5.0), ("A", None)], "underlying_symbol string, theta_efficiency double").selectExpr("*", "'call' AS option_type", "DATE '2026-03-20' AS snapshot_date")
    out = rows(groups.with_theta_below_p25(c), "theta_efficiency", "theta_efficiency_below_p25")
    assert sorted(x for x, f in out if f) == [1.0] and [f for x, f in out if x is None] == [None]


def test_historical_volatility(spark):
    prices = [100, 101, 99.5, 102]
    data = [("A", D(2026, 1, 1) + dt.timedelta(days=k), float(prices[k % 4])) for k in range(120)] + [("B", D(2026, 1, 1) + dt.timedelta(days=k), 100.0 + k) for k in range(30)]
    got = dict(rows(groups.historical_volatility(spark.createDataFrame(data, "symbol string, date date, close double"), P), "symbol", "historical_volatility"))
    last = [math.log(prices[k % 4] / prices[(k - 1) % 4]) for k in range(90, 120)]
    mean = sum(last) / 30
    assert got["A"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in last) / 29 * 252)) and got["B"] is None


def test_epochs_dates_and_symbols(spark):
    df = spark.createDataFrame([("1776403800",), ("1776403800000",), ("1776403800000000",), ("1776403800000000000",), ("2026-04-17T05:30:00Z",), ("junk",), (None,)], "x string")
    got = [r[0] for r in rows(df.select(vendors.epoch_or_text(F.col("x")).alias("t")), "t")]
    assert len(set(got[:5])) == 1 and got[5:] == [None, None]
    day = [r[0] for r in rows(spark.createDataFrame([("1777509000",), ("2026-04-30 trailing",), ("bad",)], "x string").select(vendors.event_date(F.col("x"), "America/New_York").alias("d")), "d")]
    assert day == [D(2026, 4, 29), D(2026, 4, 30), None]
    df = spark.createDataFrame([(" C ", "O:ABC "), ("put", " "), ("x", None)], "k string, s string")
    assert rows(df.select(vendors.side(F.col("k")).alias("k"), vendors.clean_symbol(F.col("s")).alias("s")), "k", "s") == [("call", "ABC"), ("put", None), (None, None)]


def test_row_findings(spark):
    good = ("A", "s", "T", "call", "2026-04-17", "100", "99", "1", "2", "true")
    bad = ("B", "s", " ", "x", "2026-13-01", "-1", "0", "3", "abc", "maybe")
    df = spark.createDataFrame([good, bad], "contract_symbol string, data_source string, underlying_symbol string, option_type string, expiration_date string, strike string, underlying_price string, bid string, ask string, is_in_the_money string")
    got = rows(validation.row_findings(df), "contract_symbol", "code", "field")
    assert {r[0] for r in got} == {"B"} and sorted((c, f) for _, c, f in got) == sorted(
        [("missing_required_field", "underlying_symbol"), ("invalid_option_type", "option_type"), ("invalid_expiration_date", "expiration_date"), ("invalid_numeric_field", "ask"),
         ("invalid_boolean_field", "is_in_the_money"), ("invalid_strike", "strike"), ("invalid_underlying_price", "underlying_price")]
    )
    assert {r.field for r in validation.missing_columns(df.drop("bid")).collect()} == {"bid"}
    assert validation.empty_frame(df.limit(0)).count() == 1 and validation.empty_frame(df).count() == 0
    assert validation.duplicate_contracts(df.unionByName(df)).count() == 4 and validation.mixed_sources(df).count() == 0


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5, "gone")], "contract_symbol string, bid double, currency string").withColumn("snapshot_date", F.lit(D(2026, 3, 20)))
    assert export.conform(df).columns == list(COLUMNS)
    export.write_parquet(df, str(tmp_path / "p"))
    export.write_csv(df, str(tmp_path / "c.csv"))
    for path in ("p", "c.csv"):
        back = vendors.read_snapshot(spark, str(tmp_path / path))
        assert rows(back, "contract_symbol", "bid", "ask") == [("A", 1.5, None)]


def test_ledger_contract(spark):
    df = spark.range(10)
    row = ledger.content_hash(df.repartition(3)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    assert ledger.check_snapshot(df, row, SCHEMA_VERSION).count() == 0
    assert {r[0] for r in rows(ledger.check_snapshot(spark.range(11), row, SCHEMA_VERSION + 1), "problem")} == {"schema_version", "row_count", "content_hash"}
    assert P.fingerprint() != Params().fingerprint()


def test_expiration_window_and_snapshot(spark):
    chain = spark.createDataFrame([("T", D(2026, 3, 20)), ("U", D(2026, 3, 20)), ("U", D(2026, 3, 21)), ("U", D(2027, 3, 21))], "underlying_symbol string, expiration_date date")
    stock = positions.parse_positions(spark.createDataFrame([("T",)], "Symbol string"))
    assert rows(attach.select_expirations(chain, stock, P).orderBy("underlying_symbol"), "underlying_symbol", "expiration_date") == [("T", D(2026, 3, 20)), ("U", D(2026, 3, 21))]
    dim = spark.createDataFrame([("T", 0.0, None), ("U", 5.0, None)], "underlying_symbol string, underlying_price double, underlying_price_time timestamp")
    assert {r[0] for r in rows(attach.attach_snapshot(chain, dim, P), "underlying_symbol")} == {"U"}


def test_positions_table_stops_at_footer(spark, tmp_path):
    (tmp_path / "p.csv").write_text('\ufeff\n,,\nSymbol, Qty,Name\n\nTSLA , 1\n -X260618C82.5,2, "a, ""b"" ",9\n,,,\nfooter text\n')
    (tmp_path / "empty.csv").write_text("\n\n")
    got = rows(vendors.read_positions(spark, str(tmp_path / "p.csv")).orderBy("line"), "cells")
    assert [r[0] for r in got] == [["Symbol", "Qty", "Name"], ["TSLA", "1", ""], ["-X260618C82.5", "2", 'a, "b"']]
    assert vendors.read_positions(spark, str(tmp_path / "empty.csv")).count() == 0


def test_calendars_become_events(spark):
    p = Params()
    raw = spark.createDataFrame(
        [("A", [["2002-01-01", "soon"], ["2002-02-03", None]], ["2002-01-20", "2002-01-05", "2002-01-09"], ["1", "x"]), ("B", None, None, None), ("C", [[]], ["1011916800"], ["0.5"])],
        "underlying_symbol string, earnings array<array<string>>, ex_date array<string>, amount array<string>",
    )
    events = vendors.flatten_calendar(raw, p)
    assert sorted((r.underlying_symbol, r.kind, str(r.event), r.amount) for r in events.collect()) == [
        ("A", "dividend", "2002-01-05", None), ("A", "dividend", "2002-01-20", 1.0), ("A", "earnings_calendar", "2002-01-01", None), ("A", "earnings_calendar", "2002-02-03", None),
        ("C", "dividend", "2002-01-24", 0.5),
    ]
    assert {r.underlying_symbol: (str(r.next_earnings_date), str(r.next_ex_div_date), r.dividend_amount) for r in vendors.next_events(events, p).collect()} == {
        "A": ("2002-02-03", "2002-01-05", None), "C": ("None", "2002-01-24", 0.5)
    }


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame([("a", float(k % 7)) for k in range(40)] + [("a", None), ("b", None), ("c", 3.0), (None, 1.5), (None, 2.5)], "g string, _n double")
    got = {r.g: (r.m, r.q) for r in groups.quantiles(df, ["g"], "_n", {"m": 0.5, "q": 0.3}).collect()}
    assert got == {r.g: (r.m, r.q) for r in df.groupBy("g").agg(F.median("_n").alias("m"), F.percentile("_n", F.lit(0.3)).alias("q")).collect()}



def test_landed_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"provider": "v", "ticker": "T", "label": "chain", "payload": {"strike": [1.0, 2.0]}}\n{"provider": "v", "label": "quote", "payload": {}}\n')
    assert vendors.read_landed(spark, str(tmp_path), "chain", "struct<strike:array<double>>").select(F.size("payload.strike")).first()[0] == 2


def test_latest_quotes_and_stream_equals_batch(spark, tmp_path):
    from strikeline.plans import enrich, tables
    from strikeline.streaming import enrichment

    sf = "/root/testdata/sf0.001"
    raw = tables.chain(spark, sf).limit(300)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = enrichment.read_quotes(spark, str(tmp_path / "in"), schema, 1)
    enrichment.enrich_stream(stream, Params(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = enrich.enrich_rows(spark.read.parquet(str(tmp_path / "in")), Params())
    found = spark.read.parquet(str(tmp_path / "out"))
    key = ["contract_symbol", "final_score", "theta_efficiency", "risk_level"]
    assert sorted(map(str, found.select(key).collect())) == sorted(map(str, batch.select(key).collect()))
    latest = enrichment.latest_quotes(spark.read.parquet(str(tmp_path / "in")), "365 days")
    assert latest.count() == found.select("contract_symbol").distinct().count()
    twice = enrichment.read_quotes(spark, str(tmp_path / "in"), schema).unionByName(enrichment.read_quotes(spark, str(tmp_path / "in"), schema))
    query = enrichment.distinct_quotes(twice).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == found.select("contract_symbol", "option_quote_time").distinct().count()


def test_scores_stay_in_range_and_partitions_do_not_matter(spark):
    from strikeline.plans import enrich, tables

    out = enrich.enrich_rows(tables.chain(spark, "/root/testdata/sf0.001"), Params())
    low, high = out.agg(F.min("final_score"), F.max("final_score")).first()
    assert 0 <= low <= high <= 100
    once = summaries.top_profitable(out).select("underlying_symbol", "contract_symbol")
    again = summaries.top_profitable(enrich.enrich_rows(tables.chain(spark, "/root/testdata/sf0.001").repartition(7, "bid"), Params())).select("underlying_symbol", "contract_symbol")
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_pricing_edge_rows(spark):
    df = spark.createDataFrame([("call", None, None, 2.0, 0), ("put", 1.0, 1.5, None, 10)], "option_type string, bid double, ask double, last_trade_price double, days_to_expiration int").selectExpr(
        "*", "100d AS strike", "90d AS underlying_price", "days_to_expiration / 365d AS time_to_expiration_years", "0.2d AS implied_volatility", "1L AS volume", "1L AS open_interest"
    )
    out = pricing.with_margin(pricing.with_premium(pricing.with_moneyness(quotes.with_quote_quality(df))))
    got = rows(out, "premium_reference_method", "itm_amount", "estimated_margin_requirement", "return_on_margin_annualized")
    assert got[0][:2] == ("last_trade_price", 0.0) and got[0][2] == pytest.approx(2 + max(18 - 10, 9)) and got[0][3] is None
    assert got[1][:2] == ("mid", 10.0) and got[1][2] == pytest.approx(1.25 + max(18 - 0, 10))


def test_best_quote_over_several_rows_of_arrays(spark):
    from strikeline.plans import queries

    parts = [("A", ["k3", "k5"], [3.0, 5.0], [9, 9]), ("A", ["k2", "k4"], [2.0, 4.0], [9, None]), ("A", ["k1"], [None], [10])]
    df = spark.createDataFrame(parts, "underlying_symbol string, key array<string>, last array<double>, updated array<long>").withColumn("changepct", F.col("last"))
    assert rows(vendors.best_quote_row(df), "underlying_symbol", "underlying_price") == [("A", 2.0)]
    packed = queries._quote_arrays(spark, "/root/testdata/sf0.001")
    assert packed.count() > packed.select("underlying_symbol").distinct().count()


def test_buckets_keep_the_order_of_values(spark):
    values = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 0.1, 0.2, 0.3, 1 - 2**-53, 1.0, 1 + 2**-52, 1.9999999, 2.0, 3.0, 1e15, 1.7e308, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(ranks.bucket(F.col("v"))).collect()]
    assert got[0] is None and got[1:] == sorted(got[1:]) and len(set(got)) > 15


def test_quantiles_of_a_hot_group_of_different_values(spark):
    """Most rows are of one group and no two values agree: its windows are over parts of it."""
    rng = random.Random(1)
    df = spark.createDataFrame([("hot" if i % 10 else f"g{i % 7}", rng.lognormvariate(0, 1) * (-1 if i % 5 == 0 else 1)) for i in range(4000)], "g string, v double")
    got = groups.quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.3})
    assert {r.g: (r.m, r.q) for r in got.collect()} == {r.g: (r.m, r.q) for r in df.groupBy("g").agg(F.median("v").alias("m"), F.percentile("v", F.lit(0.3)).alias("q")).collect()}
    cut = ranks.with_before(df, ["g"], ranks.bucket(F.col("v")), F.lit(1))
    assert cut.where("g = 'hot'").groupBy("_bucket").count().agg(F.max("count")).first()[0] < 50
    windows = re.findall(r"windowspecdefinition\(([^)]*)", got._jdf.queryExecution().optimizedPlan().toString())
    assert sum("_value" in w and "_bucket" in w for w in windows) and not any("_value" in w and "_bucket" not in w for w in windows)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("column", ["x", "name", "day"])
def test_pages_equal_a_sort(spark, column, descending):
    rng = random.Random(2)
    data = [(f"k{i:04d}", rng.choice([None, rng.randrange(-30, 30) / 4, rng.random()]), rng.choice([None, "", "Beta", "beta", "alpha", "gammaray", "Gamma"]), D(2026, 1, 1 + rng.randrange(20)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(data, "contract_symbol string, x double, name string, day date")
    key = F.lower(column) if column == "name" else F.col(column)
    want = [r.contract_symbol for r in df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "contract_symbol").collect()]
    for page in (1, 3, 10, 11, 30):
        assert [r.contract_symbol for r in summaries.sort_page(df, column, page, 37, descending).collect()] == want[(page - 1) * 37 : page * 37]


def test_samples_and_retention_of_one_slice(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("A", D(2026, 5, 1), "call", rng.choice([None, float(rng.randrange(80))]), f"c{i:03d}") for i in range(300)], "underlying_symbol string, expiration_date date, option_type string, strike double, contract_symbol string")
    ordered = [r.contract_symbol for r in df.orderBy("strike", "contract_symbol").collect()]
    got = sorted((r["rank"], r.contract_symbol) for r in summaries.even_sample(df, 20).collect())
    assert got == [(k, ordered[k]) for k in sorted({math.floor(i / 19 * 299 + 0.5) for i in range(20)})]
    runs = spark.createDataFrame([(i, rng.choice(["p", "q", None]), rng.randrange(50)) for i in range(200)] + [(500, "few", 1)], "dataset_id long, provider string, created_at int")
    want = set()
    for p in ("p", "q", None, "few"):
        own = sorted((r.created_at, r.dataset_id) for r in runs.collect() if r.provider == p)
        want |= {i for _, i in own[: max(0, len(own) - 10)]}
    assert {r.dataset_id for r in ledger.retention_candidates(runs, 10).collect()} == want and ledger.retention_candidates(runs, 0).count() == 0


def test_content_hash_counts_rows_that_stand_twice(spark):
    one = lambda *x: ledger.content_hash(spark.createDataFrame([(v, w) for v, w in x], "a string, b string")).first()
    a, b = ("x", "y"), ("z", None)
    assert one(a, a)[1] != one(b, b)[1] and one(a, b) == one(b, a) and one(("ab", "c"))[1] != one(("a", "bc"))[1] and one((None, "-"))[1] != one(("-", None))[1]


def test_snapshots_are_told_by_their_files(spark, tmp_path):
    chain = spark.createDataFrame([(1.5, D(2026, 1, 2), True)], "strike double, snapshot_date date, is_stale_quote boolean")
    export.write_parquet(chain, str(tmp_path / "plain"))
    assert rows(vendors.read_snapshot(spark, str(tmp_path / "plain")), "strike", "is_stale_quote") == [(1.5, True)]
    header = ",".join(COLUMNS)
    at = COLUMNS.index("is_stale_quote")
    (tmp_path / "table.dat").write_text("\n".join([header] + [",".join(flag if k == at else "" for k in range(len(COLUMNS))) for flag in ("1", " YES ", "true", "0", "no", "", "maybe")]))
    got = [r[0] for r in rows(vendors.read_snapshot(spark, str(tmp_path / "table.dat")), "is_stale_quote")]
    assert got == [True, True, True, False, False, None, False]


def test_positions_match_by_bins(spark):
    rng = random.Random(4)
    strike = lambda: rng.choice([rng.randrange(2000) / 1000, rng.randrange(200) / 100, 0.29, 0.28, 0.3])
    held = [("option", rng.choice("AB"), D(2026, 1, 2), "call", strike()) for _ in range(60)] + [("option", "A", D(2026, 1, 2), "put", None), ("stock", "A", None, None, None)]
    chain = [(rng.choice("AB"), D(2026, 1, 2), rng.choice(["call", "put"]), strike(), f"c{i}") for i in range(300)] + [("A", D(2026, 1, 2), "call", None, "none")]
    positions_df = spark.createDataFrame(held, "kind string, ticker string, expiration_date date, option_type string, strike double")
    chain_df = spark.createDataFrame(chain, "underlying_symbol string, expiration_date date, option_type string, strike double, contract_symbol string")
    close = lambda c, h: h[4] is not None and c[3] is not None and h[0] == "option" and c[:3] == h[1:4] and abs(c[3] - h[4]) < P.strike_tolerance
    want = {c[4] for c in chain if any(close(c, h) for h in held)}
    assert {r.contract_symbol for r in positions.match_positions(chain_df, positions_df, P).collect()} == want and 0 < len(want) < 300
    assert {r.contract_symbol for r in positions.match_positions(chain_df, positions_df, P, "left_anti").collect()} == {c[4] for c in chain} - want
    first = {h[1:]: min(((c[3], c[4]) for c in chain if close(c, h)), default=(None, None))[1] for h in held if h[4] is not None}
    assert {(r.ticker, r.expiration_date, r.option_type, r.strike): r.contract_symbol for r in positions.position_coverage(positions_df, chain_df, P).collect()} == first


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    from strikeline.plans import tables
    from strikeline.streaming import enrichment

    for part in range(2):
        tables.chain(spark, "/root/testdata/sf0.001").where(f"_order % 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, book = str(tmp_path / "out"), str(tmp_path / "ledger")
    stream = enrichment.read_quotes(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    enrichment.enrich_with_ledger(stream, Params(), out, book, str(tmp_path / "cp")).awaitTermination()
    seen = lambda: (spark.read.parquet(out).count(), sorted(map(tuple, spark.read.parquet(book).select("batch_id", "row_count", "content_hash").collect())))
    before = seen()
    assert before[0] == spark.read.parquet(str(tmp_path / "in")).count() == sum(r[1] for r in before[1]) and len(before[1]) == 2
    again = spark.read.parquet(out).where("batch_id = 1").select(*stream.columns)
    again.write.parquet(str(tmp_path / "again"))
    enrichment.write_batch(spark.read.parquet(str(tmp_path / "again")), 1, Params(), out, book)
    assert seen() == before


def test_latest_quotes_across_days_and_a_restart(spark, tmp_path):
    from strikeline.streaming import enrichment

    schema = "contract_symbol string, option_quote_time timestamp, bid double, ask double"
    at = lambda day, hour: dt.datetime(2026, 3, day, hour, tzinfo=dt.timezone.utc)
    days = [
        [("A", at(2, 10), 1.0, 2.0), ("A", at(2, 11), None, 2.5), ("B", at(2, 9), 3.0, 4.0), ("D", at(2, 9), 1.0, 1.0)],
        [("A", at(3, 10), 1.5, 2.0), ("A", at(3, 10), 1.5, 2.5), ("C", at(3, 9), 5.0, None), ("B", at(2, 8), 9.0, 9.0), ("A", None, 7.0, 7.0)],
        [("B", at(4, 9), 6.0, 7.0), ("A", at(4, 8), 1.0, 1.0), ("A", at(3, 11), 8.0, 8.0), ("C", at(3, 8), 0.0, 0.0)],
    ]
    got = {}

    def merge(df, _):
        got.update({r.contract_symbol: (r.option_quote_time, r.bid, r.ask) for r in df.collect()})

    for data in days:  # each day is a run of its own, from the same checkpoint
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = enrichment.read_quotes(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
        enrichment.latest_quotes_across_days(stream).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.parquet(str(tmp_path / "in")).where("option_quote_time IS NOT NULL").groupBy("contract_symbol").agg(F.max(F.struct("option_quote_time", "bid", "ask")).alias("q")).select("contract_symbol", "q.*")
    assert got == {r.contract_symbol: (r.option_quote_time, r.bid, r.ask) for r in batch.collect()}


def test_content_hash_is_that_of_its_definition(spark):
    import hashlib

    df = spark.sql("SELECT * FROM VALUES ('é!', 1.5D, 7, true, DATE'2026-01-02', TIMESTAMP'2026-01-02 03:04:05.5', 2.50BD), (NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('', -0.0D, -1, false, NULL, NULL, 0.00BD) AS t(a, b, c, d, e, f, g)")
    texts = [["é!", "1.5", "7", "true", "2026-01-02", "2026-01-02 03:04:05.5", "2.50"], [None] * 7, ["", "-0.0", "-1", "false", None, None, "0.00"]]
    h = [hashlib.sha256("".join("-" if x is None else f"{len(x)}:{x}" for x in r).encode()).hexdigest() for r in texts]
    want = "-".join(str(sum(int(x[k : k + 15], 16) for x in h)) for k in (0, 15))
    assert tuple(ledger.content_hash(df).first()) == (3, want)
    plan = ledger.content_hash(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("octet_length") == 6 and plan.count("char_length") + plan.count(" length(") <= 1  # one pass over the text where it can have longer signs


def test_a_first_batch_of_empty_files_has_a_ledger_row(spark, tmp_path):
    from strikeline.plans import tables
    from strikeline.streaming import enrichment

    none = tables.chain(spark, "/root/testdata/sf0.001").where("false")
    none.write.parquet(str(tmp_path / "in"))
    enrichment.write_batch(spark.read.parquet(str(tmp_path / "in")), 0, Params(), str(tmp_path / "out"), str(tmp_path / "ledger"))
    assert [r.row_count for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == [0]


def test_quantiles_of_stored_rows_shuffle_few_of_them(spark):
    """Only rows of the buckets that hold a wanted place are ranked; a group without values keeps its row."""
    values = [(k * 7919 % 10007) / 100.0 for k in range(10007)]
    rows = [("a", v) for v in values] + [("b", 1.5), ("b", None), ("b", -2.0), ("c", None), ("d", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    sent = []

    def store(buckets):
        sent.append(buckets.count())
        return buckets

    at = {"m": 0.5, "q": 0.3, "e": 0.999}
    got = {r.g: tuple(r) for r in groups.quantiles(df, ["g"], "v", at, store).collect()}
    assert got == {r.g: tuple(r) for r in groups.quantiles(df, ["g"], "v", at).collect()}
    assert got["a"][:3] == ("a", 10007, 50.03) and got["b"][:3] == ("b", 2, -0.25) and got["c"] == ("c", 0, None, None, None) and got["d"] == ("d", 1, 0.0, 0.0, 0.0)
    assert len(sent) == 1 and sent[0] <= 10


def test_a_batch_of_one_file_is_written_by_all_cores_and_hashed_as_it_is_stored(spark, tmp_path):
    """Rows of few dates go below them as they come, those of more are sorted; either way the ledger's hash is that of the stored rows, in which missing dates count."""
    from strikeline.plans import tables
    from strikeline.streaming import enrichment

    chain = tables.chain(spark, "/root/testdata/sf0.001")
    for batch, date in enumerate(("IF(_line = 3, NULL, snapshot_date)", "IF(_line = 3, NULL, date_add(snapshot_date, _line))")):
        path, out, book = (str(tmp_path / f"{x}{batch}") for x in ("in", "out", "ledger"))
        chain.withColumn("snapshot_date", F.expr(date)).coalesce(1).write.parquet(path)
        enrichment.write_batch(spark.read.parquet(path), batch, Params(), out, book)
        stored = spark.read.parquet(out).drop("batch_id")
        entry = spark.read.parquet(book).first()
        assert entry[:2] == ledger.content_hash(stored).first()[:] and entry.row_count == chain.count()
        assert (entry.first_date, entry.last_date, entry.batch_id) == (*stored.agg(F.min("snapshot_date"), F.max("snapshot_date")).first(), batch)
        assert len({f.name.split("-")[1] for f in (tmp_path / f"out{batch}").rglob("part-*.parquet")}) == spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_landed_quotes_have_small_row_groups(spark, tmp_path, monkeypatch):
    """A batch of few files is read by all cores, each of which gets row groups of its own."""
    import pyarrow.parquet as pq

    from strikeline.plans import streams
    from strikeline.plans.queries import QUERIES

    monkeypatch.setattr(streams, "new_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(streams, "ROW_GROUP", 20_000)
    assert QUERIES["stream_enrichment"](spark, "/root/testdata/sf0.001").count() > 0
    assert any(pq.ParquetFile(f).num_row_groups > 1 for f in (tmp_path / "in").glob("part-*.parquet"))
