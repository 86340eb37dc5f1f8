"""Rankings, per-underlying summaries, freshness reports and table views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions import ranks
from strikeline.functions.mathx import holds
from strikeline.operators import groups
from strikeline.operators.screens import seconds_before
from strikeline.params import Params

#: Last tie-breakers of every ranking.
TIES = ("option_type", "strike", "contract_symbol")
SLICE = ["underlying_symbol", "expiration_date", "option_type"]
#: What a ranked contract is shown with.
RANKED = (
    "underlying_symbol", "contract_symbol", "option_type", "expiration_date", "strike", "premium_reference_price", "return_on_margin_annualized", "probability_itm", "delta_abs",
    "strike_distance_pct", "risk_level", "spread_score", "dte_score", "theta_efficiency", "quote_quality_score", "option_score", "final_score", "bid_ask_spread_pct_of_mid", "event_risk_score",
)


def primary_candidates(chain: DataFrame) -> DataFrame:
    """Rows that pass the primary screen; all rows where the flag was never computed."""
    return chain.where("passes_primary_screen") if "passes_primary_screen" in chain.columns else chain


def percent(x: Column) -> Column:
    return F.round(x * 100.0, 1)


def opportunity(chain: DataFrame) -> DataFrame:
    """The compact fields of a ranked contract."""
    shown = lambda c: F.coalesce(percent(F.col(c)).cast("string"), F.lit("—"))
    summary = F.concat(F.lit("ROM "), shown("return_on_margin_annualized"), F.lit("% · ITM "), shown("probability_itm"), F.lit("% · spread "), shown("bid_ask_spread_pct_of_mid"), F.lit("%"))
    return chain.select(
        "underlying_symbol", "contract_symbol", "option_type", "expiration_date", "strike", "premium_reference_price",
        percent(F.col("return_on_margin_annualized")).alias("return_on_margin_annualized_pct"), percent(F.col("probability_itm")).alias("probability_itm_pct"), "delta_abs",
        percent(F.col("strike_distance_pct")).alias("strike_distance_pct"), "risk_level", "spread_score", "dte_score", "theta_efficiency", "quote_quality_score",
        "option_score", "final_score", percent(F.col("bid_ask_spread_pct_of_mid")).alias("bid_ask_spread_pct_of_mid"), "event_risk_score", summary.alias("summary"),
    )


def _first(df: DataFrame, order: list[Column], keys: tuple[str, ...] = ("underlying_symbol",), also: tuple[str, ...] = ()) -> DataFrame:
    """The row of each group that comes first in an ascending order, with RANKED and also; tasks keep one row of a group each.

    By structs alone Spark sorts all rows by group. Next to a collected set it hashes the groups and holds one row of each; that set is of nothing.
    """
    rest = F.struct(*(c for c in (*RANKED, *also) if c not in keys))
    best = F.min_by(rest, F.struct(*(x.alias(f"_{k}") for k, x in enumerate(order)), *TIES)).alias("_first")
    found = df.groupBy(*keys).agg(best, F.collect_set(F.lit(None).cast("boolean")).alias("_none"))
    return found.where(F.size("_none") == 0).select(*keys, "_first.*")


def _up(x: str) -> list[Column]:
    """Least first, missing last."""
    return [F.col(x).isNull(), F.col(x)]


def _down(x: str) -> list[Column]:
    """Greatest first, missing last."""
    return [F.col(x).isNull(), -F.col(x)]


def top_profitable(chain: DataFrame) -> DataFrame:
    """Per underlying, the candidate of the highest annualised return on margin."""
    c = primary_candidates(chain).withColumns({"_final": F.coalesce("final_score", "option_score", F.lit(0.0)), "_quality": F.coalesce("quote_quality_score", F.lit(0))})
    return opportunity(_first(c, [*_down("return_on_margin_annualized"), *_down("_final"), *_down("_quality")]))


def top_moderate(chain: DataFrame, params: Params) -> DataFrame:
    """Per underlying, the best-scored candidate of delta up to 0.40 and a tight spread, or else of delta up to 0.45."""
    c = primary_candidates(chain).withColumn("_final", F.coalesce("final_score", "option_score", F.lit(0.0)))
    tier = F.when((F.col("delta_abs") <= 0.40) & (F.col("bid_ask_spread_pct_of_mid") <= params.max_spread_pct_of_mid), 1).when(F.col("delta_abs") <= 0.45, 2)
    # the first tier wins whole, so ranking by tier first is the fallback
    ranked = c.withColumn("_tier", tier).where("_tier is not null")
    return opportunity(_first(ranked, [*_up("_tier"), *_down("_final"), *_down("return_on_margin_annualized"), *_up("delta_abs")]))


def top_conviction(chain: DataFrame) -> DataFrame:
    """Per underlying and side, the candidate of the highest directional score."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    call = F.col("option_type") == "call"
    align = zero("underlying_day_change_pct") * F.when(call, 1.0).otherwise(-1.0)
    away = F.coalesce(F.abs(F.col("delta_abs") - F.when(call, 0.40).otherwise(0.35)), F.lit(1.0))
    final = F.coalesce(F.col("final_score"), F.lit(0.0))
    score = (
        final + zero("quote_quality_score") * 2.0 + zero("spread_score") * 0.5 + align * 300.0
        - F.coalesce(F.col("strike_distance_pct"), F.lit(1.0)) * 100.0 - away * 40.0 + zero("return_on_margin_annualized") * 5.0
    )
    c = primary_candidates(chain).where(F.col("option_type").isin("call", "put"))
    c = c.withColumns({"_score": F.round(score, 9), "_final": final, "_quality": zero("quote_quality_score"), "_spread": zero("spread_score")})
    order = [*_down("_score"), *_down("_final"), *_down("_quality"), *_down("_spread"), *_up("strike_distance_pct")]
    best = _first(c, order, ("underlying_symbol", "option_type"), ("_score",))
    return opportunity(best).join(best.select("underlying_symbol", "option_type", F.col("_score").alias("conviction_score")), ["underlying_symbol", "option_type"])


def ticker_summary(chain: DataFrame) -> DataFrame:
    """One row per underlying: counts, price, volatility context and events. The first of several values is the least symbol's."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("contract_symbol")))
    named = chain.where(F.col("underlying_symbol").isNotNull())
    agg = named.groupBy("underlying_symbol").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("option_type") == "call").alias("call_count"), F.count_if(F.col("option_type") == "put").alias("put_count"),
        F.countDistinct("expiration_date").alias("expiration_count"), first("underlying_price").alias("underlying_price"), first("underlying_day_change_pct").alias("_change"),
        first("historical_volatility").alias("_hv"), first("next_earnings_date").alias("next_earnings_date"),
        first("next_earnings_date_is_estimated").alias("next_earnings_date_is_estimated"), first("event_risk_score").alias("event_risk_score"),
    )
    agg = agg.join(groups.quantiles(named, ["underlying_symbol"], "implied_volatility", {"_iv": 0.5}).drop("_n"), "underlying_symbol", "left")
    out = agg.withColumns({"underlying_day_change_pct": percent(F.col("_change")), "median_implied_volatility_pct": percent(F.col("_iv")), "historical_volatility_pct": percent(F.col("_hv"))})
    hv = F.nullif(F.col("historical_volatility_pct"), F.lit(0.0))
    return out.withColumn("iv_hv_ratio", F.round(F.col("median_implied_volatility_pct") / hv, 2)).drop("_iv", "_hv")


def with_status(summary: DataFrame) -> DataFrame:
    """latest_status and market_context of ticker_summary's rows."""
    # The labels and sentences below.
    move, iv, hv = F.col("_change") * 100.0, F.col("median_implied_volatility_pct"), F.col("historical_volatility_pct")
    one = lambda x: F.format_string("%.1f", x)
    moved = F.when(move > 0.2, F.concat(F.lit("Up "), one(move), F.lit("%"))).when(move < -0.2, F.concat(F.lit("Down "), one(-move), F.lit("%"))).when(move.isNotNull(), "Flat")
    rel = F.when(hv > 0, iv / hv)
    rich = F.when(rel >= 1.15, "IV rich").when(rel <= 0.9, "IV soft").when(rel.isNotNull(), "IV balanced").when(iv.isNotNull(), "IV available")
    status = F.when(move.isNull() & iv.isNull() & hv.isNull(), "Snapshot unavailable").otherwise(F.coalesce(F.nullif(F.concat_ws(" · ", moved, rich), F.lit("")), F.lit("Snapshot available")))
    price = F.concat(F.col("underlying_symbol"), F.lit(" last underlying price was "), F.format_string("%.2f", F.col("underlying_price")))
    context = (
        F.when(F.col("underlying_price").isNull() & move.isNull(), F.concat("underlying_symbol", F.lit(" has no recent underlying snapshot in this file.")))
        .when(move.isNull(), F.concat(price, F.lit(".")))
        .otherwise(F.concat(price, F.when(move >= 0, F.lit(", up ")).otherwise(F.lit(", down ")), one(F.abs(move)), F.lit("% versus previous close.")))
    )
    return summary.withColumns({"latest_status": status, "market_context": context})


def highlights(profitable: DataFrame, moderate: DataFrame) -> DataFrame:
    """The underlying whose pick has the highest return, of each kind; a return of 0 beats a missing one, ties go to the first symbol."""
    one = lambda df, kind: df.orderBy(F.desc_nulls_last("return_on_margin_annualized_pct"), "underlying_symbol").limit(1).select(F.lit(kind).alias("highlight"), "underlying_symbol", "contract_symbol", "return_on_margin_annualized_pct")
    return one(profitable, "most_profitable").unionByName(one(moderate, "moderate_risk"))


def freshness_summary(chain: DataFrame) -> DataFrame:
    """Median and greatest age of quotes and underlying prices; missing where there are none."""
    ages = {"option_quote_age": "quote_age_seconds", "underlying_quote_age": "underlying_price_age_seconds"}
    # both kinds of ages are groups of one frame, so that it is read once
    rows = chain.select(F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), F.col(c).cast("double").alias("age")) for name, c in ages.items()))).alias("x")).select("x.*")
    medians = groups.quantiles(rows, ["kind"], "age", {"value": 0.5}).select("kind", F.lit("median").alias("of"), "value")
    found = medians.unionByName(rows.groupBy("kind").agg(F.max("age").alias("value")).select("kind", F.lit("max").alias("of"), "value"))
    return found.agg(*(F.max(F.when((F.col("kind") == name) & (F.col("of") == of), F.col("value"))).alias(f"{name}_{of}_seconds") for name in ages for of in ("median", "max")))


def freshness_now(chain: DataFrame, params: Params) -> DataFrame:
    """For quotes and underlyings: rows with a time, stale now, stale when fetched, and the newest and oldest time and age."""
    out = None
    for kind, ts, flag in (("quotes", "option_quote_time", "is_stale_quote"), ("underlyings", "underlying_price_time", "is_stale_underlying_price")):
        age = seconds_before(F.lit(params.as_of), F.col(ts))
        row = chain.where(F.col(ts).isNotNull()).agg(
            F.count("*").alias("rows_with_timestamp"), F.count_if(age > params.stale_quote_seconds).alias("stale_now_rows"), F.count_if(F.col(flag)).alias("stale_at_fetch_rows"),
            F.max(ts).alias("newest_timestamp"), F.min(ts).alias("oldest_timestamp"), F.min(age).alias("newest_age_seconds"), F.max(age).alias("oldest_age_seconds"),
        ).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def stale_underlyings(chain: DataFrame, params: Params) -> DataFrame:
    """Underlyings whose newest price is stale."""
    age = lambda c: seconds_before(F.lit(params.as_of), F.col(c))
    per = chain.where(F.col("underlying_symbol").isNotNull() & F.col("underlying_price_time").isNotNull()).groupBy(F.col("underlying_symbol").alias("symbol")).agg(
        F.count("*").alias("row_count"), F.countDistinct("underlying_price_time").alias("distinct_timestamps"), F.max("underlying_price_time").alias("newest_timestamp"), F.min("underlying_price_time").alias("oldest_timestamp")
    )
    out = per.withColumns({"newest_age_seconds": age("newest_timestamp"), "oldest_age_seconds": age("oldest_timestamp")})
    return out.where(F.col("newest_age_seconds") > params.stale_quote_seconds).orderBy(F.desc("newest_age_seconds"), F.desc("symbol"))


def freshness_gate(chain: DataFrame, params: Params) -> DataFrame:
    """ok, warn or block for each underlying, by the age of its oldest price."""
    per = chain.groupBy("underlying_symbol").agg(F.min("underlying_price_time").alias("oldest"))
    age = seconds_before(F.lit(params.as_of), F.col("oldest"))
    return per.select("underlying_symbol", age.alias("oldest_age_seconds"), F.when(age > params.block_age_seconds, "block").when(age > params.warn_age_seconds, "warn").otherwise("ok").alias("gate"))


def dataset_constants(chain: DataFrame, columns: tuple[str, ...] = ("premium_reference_method", "risk_free_rate_used", "data_source")) -> DataFrame:
    """Name and value of each column that has exactly one value."""
    text = [c for c in columns if c in chain.columns]
    row = chain.agg(*(F.struct(F.countDistinct(c).alias("n"), F.max(F.col(c).cast("string")).alias("value"), F.lit(c).alias("name")).alias(f"_{c}") for c in text))
    return row.select(F.explode(F.array(*(F.col(f"_{c}") for c in text))).alias("x")).where("x.n = 1").select("x.name", "x.value")


def column_metadata(df: DataFrame) -> list[tuple[str, bool]]:
    """Each column and whether it is numeric; booleans are not."""
    kinds = ("byte", "short", "integer", "long", "float", "double", "decimal")
    return [(f.name, f.dataType.typeName() in kinds) for f in df.schema.fields]


def chain_slice(chain: DataFrame, ticker: str, expiration: object, side: str = "all") -> DataFrame:
    """One underlying and expiration, and one side or all, by strike."""
    rows = chain.where((F.col("underlying_symbol") == ticker) & (F.col("expiration_date") == F.lit(expiration)))
    return (rows if side == "all" else rows.where(F.col("option_type") == side)).orderBy("strike", "option_type", "contract_symbol")


def chain_totals(chain: DataFrame) -> DataFrame:
    n = F.count("*")
    return chain.groupBy(*SLICE).agg(
        n.alias("contracts"), (F.count_if(holds(F.col("passes_primary_screen"))) / n).alias("pass_share"), F.sum(F.coalesce("volume", F.lit(0))).alias("total_volume"), F.sum(F.coalesce("open_interest", F.lit(0))).alias("total_open_interest")
    )


def risk_mix(chain: DataFrame) -> DataFrame:
    n = F.count("*")
    level = lambda x: F.count_if(F.upper("risk_level") == x)
    return chain.groupBy(*SLICE).agg(*(f(x) for x in ("LOW", "MODERATE", "HIGH") for f in (lambda x: level(x).alias(f"{x.lower()}_count"), lambda x: (level(x) / n).alias(f"{x.lower()}_share"))))


def liquidity_topk(chain: DataFrame, k: int = 6) -> DataFrame:
    """The k most liquid contracts of each slice; Spark keeps k of each before the shuffle too, so a hot slice is not one task."""
    liquid = F.coalesce("open_interest", F.lit(0)) + F.coalesce("volume", F.lit(0))
    w = Window.partitionBy(*SLICE).orderBy(F.desc("liquidity"), "strike", "contract_symbol")
    return chain.where("strike is not null").withColumn("liquidity", liquid).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sort_page(df: DataFrame, column: str, page: int, size: int, descending: bool = False, ties: tuple[str, ...] = ("contract_symbol",)) -> DataFrame:
    """One page of a table sorted by a column: numbers as numbers, text without regard to case, missing values last. Pages count from 1.

    Buckets of the column are counted, and only the rows of those that the page touches are sorted, each bucket by itself; so a deep page costs what the first one does.
    """
    kind = dict(df.dtypes)[column]
    key = F.lower(column) if kind == "string" else F.col(column)
    plain = F.unix_micros(key.cast("timestamp")) if kind in ("date", "timestamp") else key.cast("int") if kind == "boolean" else key
    by = ranks.text_bucket(key) if kind == "string" else ranks.bucket(plain)
    first = (max(page, 1) - 1) * size
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), *map(F.col, ties)]
    cut = ranks.with_before(df, [], by, F.lit(1), descending, missing_last=True)
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    near = cut.where(F.col("_before") < first + size).withColumn("_rank", F.col("_before") + own - 1)
    return near.where(F.col("_rank").between(first, first + size - 1)).orderBy("_rank").drop("_bucket", "_before", "_total", "_rank")


def even_sample(chain: DataFrame, points: int) -> DataFrame:
    """At most `points` rows of each slice at evenly spaced ranks by strike."""
    ranked = ranks.with_rank(chain, SLICE, ranks.bucket(F.col("strike")), [F.col("strike"), F.col("contract_symbol")])
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i / max(points - 1, 1) * (F.col("_total") - 1) + 0.5))
    return ranked.where((F.col("_total") <= points) | F.array_contains(at, F.col("rank"))).drop("_total")


def extents(chain: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Least and greatest value of each column in each slice."""
    return chain.groupBy(*SLICE).agg(*(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max))))
