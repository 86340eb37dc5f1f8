"""Landed vendor payloads as chain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.functions.mathx import number
from strikeline.params import Params
from strikeline.schema import BOOLEANS, CHAIN

# Vendor names of canonical columns.
FLAT_NAMES = {
    "contractSymbol": "contract_symbol", "lastTradeDate": "option_quote_time", "lastPrice": "last_trade_price", "percentChange": "percent_change",
    "openInterest": "open_interest", "impliedVolatility": "implied_volatility", "inTheMoney": "is_in_the_money", "contractSize": "contract_size",
}
ARRAY_NAMES = {
    "optionSymbol": "contract_symbol", "underlying": "underlying_symbol", "side": "option_type", "updated": "option_quote_time", "last": "last_trade_price",
    "openInterest": "open_interest", "iv": "implied_volatility",
}
NUMBERS = (
    "strike", "last_trade_price", "bid", "ask", "change", "percent_change", "volume", "open_interest", "implied_volatility",
)

NESTED = (
    "details struct<ticker:string,contract_type:string,expiration_date:string,strike_price:double,shares_per_contract:string>, "
    "last_quote struct<bid:double,bid_price:double,ask:double,ask_price:double,last_updated:string,sip_timestamp:string>, last_trade struct<price:double,sip_timestamp:string>, "
    "day struct<change:double,change_percent:double,volume:double,close:double,previous_close:double,last_updated:string>, greeks struct<delta:double,gamma:double,theta:double,vega:double>, "
    "implied_volatility double, open_interest double, underlying_asset struct<ticker:string,price:double,value:double,last_updated:string>"
)


def epoch_or_text(x: Column) -> Column:
    """A timestamp from text, or from a number of seconds, milli-, micro- or nanoseconds, told apart by size; bad values are missing."""
    text = x.cast("string")
    n = text.try_cast("double")
    size = F.abs(n)
    # whole numbers keep all their digits
    whole = text.try_cast("decimal(38,6)")
    micros = F.when(size >= 1e17, whole / 1000).when(size >= 1e14, whole).when(size >= 1e11, whole * 1000).otherwise(whole * 1000000)
    return F.when(n.isNotNull(), F.timestamp_micros(F.floor(micros).try_cast("bigint"))).otherwise(text.try_cast("timestamp"))


def event_date(x: Column, zone: str) -> Column:
    """A date from an epoch, in the market's zone, or from text, by its first ten characters; bad values are missing."""
    text = x.cast("string")
    n = text.try_cast("double")
    return F.when(n.isNotNull(), F.to_date(F.from_utc_timestamp(epoch_or_text(text), zone))).otherwise(F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def market_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def side(x: Column) -> Column:
    """call, put or missing."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("call", "c"), "call").when(t.isin("put", "p"), "put")


def clean_symbol(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(x), "^O:", ""), F.lit(""))


def in_the_money(option_type: Column, spot: Column, strike: Column) -> Column:
    return F.when(option_type == "call", spot > strike).when(option_type == "put", spot < strike)


def day_counts(chain: DataFrame, params: Params) -> DataFrame:
    days = F.datediff(F.col("expiration_date"), F.lit(params.today))
    return chain.withColumns({"days_to_expiration": days, "time_to_expiration_years": days / F.lit(365.0)})


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: number(F.col(c).cast("string")) for c in NUMBERS if c in df.columns})


def normalize_flat(raw: DataFrame, params: Params, ticker: str | None = None, data_source: str | None = None) -> DataFrame:
    """Flat vendor rows under canonical names and types, with tenor and constants. raw may hold expiration_date, option_type, underlying_price."""
    df = _numbers(raw.withColumnsRenamed(FLAT_NAMES))
    symbol = F.col("underlying_symbol") if "underlying_symbol" in df.columns else F.lit(None).cast("string")
    df = df.withColumns(
        {
            "underlying_symbol": F.coalesce(symbol, F.lit(ticker)),
            "expiration_date": event_date(F.col("expiration_date"), params.market_zone),
            "option_quote_time": epoch_or_text(F.col("option_quote_time")),
            "risk_free_rate_used": F.lit(params.risk_free_rate),
        }
    )
    df = df.withColumn("data_source", F.lit(data_source)) if data_source is not None else df
    return day_counts(df, params)


def normalize_nested(raw: DataFrame, params: Params, data_source: str = "nested") -> DataFrame:
    """Rows of nested snapshots, flattened, each field from the first place that has it; unknown contract types go."""
    c = F.col
    quote_time = F.coalesce("last_quote.last_updated", "last_quote.sip_timestamp", "last_trade.sip_timestamp", "day.last_updated")
    spot = F.coalesce("underlying_asset.price", "underlying_asset.value")
    kind = side(c("details.contract_type"))
    df = raw.select(
        c("underlying_asset.ticker").alias("underlying_symbol"), clean_symbol(c("details.ticker")).alias("contract_symbol"), kind.alias("option_type"),
        event_date(c("details.expiration_date"), params.market_zone).alias("expiration_date"), c("details.strike_price").alias("strike"), spot.alias("underlying_price"),
        epoch_or_text(c("underlying_asset.last_updated")).alias("underlying_price_time"), F.coalesce("last_quote.bid", "last_quote.bid_price").alias("bid"),
        F.coalesce("last_quote.ask", "last_quote.ask_price").alias("ask"), F.coalesce("last_trade.price", "day.close").alias("last_trade_price"), c("day.change").alias("change"),
        c("day.change_percent").alias("percent_change"), c("day.volume").alias("volume"), "open_interest", "implied_volatility", epoch_or_text(quote_time).alias("option_quote_time"),
        in_the_money(kind, spot, c("details.strike_price")).alias("is_in_the_money"), F.coalesce("details.shares_per_contract", F.lit("REGULAR")).alias("contract_size"),
        *(c(f"greeks.{g}").alias(g) for g in ("delta", "gamma", "theta", "vega")),
    )
    out = _numbers(df.where("option_type is not null")).withColumns({"data_source": F.lit(data_source), "risk_free_rate_used": F.lit(params.risk_free_rate)})
    return day_counts(out, params)


def normalize_arrays(raw: DataFrame, params: Params, data_source: str = "arrays") -> DataFrame:
    """Rows of parallel arrays, one input row per underlying; a short array is missing at its end."""
    names = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType)]
    rows = raw.select(F.inline(F.arrays_zip(*names))).withColumnsRenamed(ARRAY_NAMES)
    rows = _numbers(rows).withColumns(
        {
            "option_type": side(F.col("option_type")),
            "expiration_date": event_date(F.col("expiration"), params.market_zone),
            "option_quote_time": epoch_or_text(F.col("option_quote_time")),
            "data_source": F.lit(data_source),
            "risk_free_rate_used": F.lit(params.risk_free_rate),
        }
    )
    return day_counts(rows, params)


def read_landed(spark: SparkSession, path: str, label: str, payload: str) -> DataFrame:
    """Payloads of one label from landed envelopes (provider, ticker, label, fetched_at, payload as JSON of the given schema)."""
    schema = f"provider string, ticker string, label string, fetched_at string, payload {payload}"
    return spark.read.schema(schema).json(path).where(F.col("label") == label)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot: Parquet where the path, or else the first file of the folder, ends in .parquet; anything else is CSV with the canonical schema, whose flags
    may be written in any of the ways of `truthy`."""
    if path.rstrip("/").endswith(".parquet") or (_first_file(spark, path) or "").endswith(".parquet"):
        return spark.read.parquet(path)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in BOOLEANS else f.dataType) for f in CHAIN.fields])
    rows = spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path)
    return rows.withColumns({c: truthy(F.col(c)) for c in BOOLEANS if c in CHAIN.names})


def _first_file(spark: SparkSession, path: str) -> str | None:
    """The name of a data file below a folder, or of the file itself; by the file system that the path is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return name
    return None


def truthy(x: Column) -> Column:
    """Whether a text flag says true, 1 or yes, in any case and with spaces around; missing and blank stay missing, anything else is false."""
    text = F.lower(F.trim(x.cast("string")))
    return F.when(F.coalesce(text, F.lit("")) != "", text.isin("true", "1", "yes"))


def csv_cells(line: Column) -> Column:
    """Trimmed cells of a line; a quoted cell may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('(\\s*"(?:[^"]|"")*"\\s*|[^,]*),'), F.lit(1))
    plain = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.transform(raw, lambda x: F.trim(x)), lambda x: F.trim(plain(x)))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of positions exports, the header first, up to the first blank line after the data, as (line, cells). Blank lines before the header and
    before the data are skipped, cells are trimmed, short rows are padded to the header's cells and longer ones cut."""
    files = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n").alias("lines"))
    rows = files.select(F.transform("lines", csv_cells).alias("rows"))
    filled = lambda r: F.exists(r, lambda x: x != "")
    first = F.array_position(F.transform("rows", filled), True).cast("int")
    rows = rows.where(first > 0).select(F.get("rows", first - 1).alias("header"), F.slice("rows", first + 1, F.size("rows")).alias("rows"))
    data = F.array_position(F.transform("rows", filled), True).cast("int")
    rows = rows.select("header", F.when(data > 0, F.slice("rows", data, F.size("rows"))).otherwise(F.slice("rows", 1, 0)).alias("rows"))
    end = F.array_position(F.transform("rows", filled), False).cast("int")
    rows = rows.select("header", F.concat(F.array("header"), F.when(end > 0, F.slice("rows", F.lit(1), end - 1)).otherwise(F.col("rows"))).alias("rows"))
    padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size("header"))), F.lit(1), F.size("header"))
    return rows.select(F.posexplode(F.transform("rows", padded)).alias("line", "cells"))


def flatten_calendar(payloads: DataFrame, params: Params) -> DataFrame:
    """Landed calendars as events of next_events. payloads: underlying_symbol, earnings (nested arrays of dates or epochs), ex_date and amount
    (parallel arrays, of which the shorter counts). Values that are no dates go; amounts that are no numbers are missing."""
    dated = lambda x: event_date(x, params.market_zone)
    none = F.lit(None)
    earnings = payloads.select("underlying_symbol", F.posexplode(F.flatten("earnings")).alias("seq", "raw"))
    earnings = earnings.select("underlying_symbol", F.lit("earnings_calendar").alias("kind"), dated(F.col("raw")).alias("event"), none.cast("boolean").alias("is_estimated"), none.cast("double").alias("amount"), "seq")
    n = F.least(F.size("ex_date"), F.size("amount"))
    dividends = payloads.where(n > 0).select("underlying_symbol", F.posexplode(F.slice(F.arrays_zip("ex_date", "amount"), F.lit(1), n)).alias("seq", "d"))
    dividends = dividends.select("underlying_symbol", F.lit("dividend").alias("kind"), dated(F.col("d.ex_date")).alias("event"), none.cast("boolean").alias("is_estimated"), number(F.col("d.amount").cast("string")).alias("amount"), "seq")
    return earnings.unionByName(dividends).where("event is not null")


def best_quote_row(quotes: DataFrame) -> DataFrame:
    """Of each underlying's arrays `last` and `updated`, the newest entry with a price; a missing time loses, the first index wins ties.
    An underlying may have several rows of arrays; an array `key` then gives the order of entries over all of them, before the index."""
    fields = [*(["key"] if "key" in quotes.columns else []), "last", "updated", "changepct"]
    rows = quotes.select("underlying_symbol", F.posexplode(F.arrays_zip(*fields)).alias("pos", "q")).where("q.last is not null")
    # the least of (has no time, -time, key, index)
    order = F.struct(F.col("q.updated").isNull(), -F.coalesce("q.updated", F.lit(0)), *(F.col(f"q.{k}") for k in fields if k == "key"), F.col("pos"))
    return rows.groupBy("underlying_symbol").agg(F.min_by(F.struct("pos", "q"), order).alias("b")).select(
        "underlying_symbol", F.col("b.q.last").alias("underlying_price"), epoch_or_text(F.col("b.q.updated")).alias("underlying_price_time"), F.col("b.q.changepct").alias("underlying_day_change_pct")
    )


def underlying_snapshot(quotes: DataFrame, chain: DataFrame) -> DataFrame:
    """Price of each underlying from its best quote, or else from the newest chain row that has a price."""
    best = best_quote_row(quotes)
    order = F.struct(F.col("option_quote_time").isNotNull(), F.coalesce(F.col("option_quote_time"), F.lit("1900-01-01").cast("timestamp")), F.col("contract_symbol"))
    last = chain.where("underlying_price is not null").groupBy("underlying_symbol").agg(F.max_by(F.struct("underlying_price", "option_quote_time"), order).alias("c"))
    joined = last.join(best.withColumnRenamed("underlying_symbol", "_s"), F.col("underlying_symbol") == F.col("_s"), "full_outer")
    return joined.select(
        F.coalesce("underlying_symbol", "_s").alias("underlying_symbol"), F.coalesce("underlying_price", "c.underlying_price").alias("underlying_price"),
        F.when(F.col("underlying_price").isNotNull(), F.col("underlying_price_time")).otherwise(F.col("c.option_quote_time")).alias("underlying_price_time"), "underlying_day_change_pct",
    )


def day_change(last: Column, previous: Column) -> Column:
    return F.when(previous > 0, (last - previous) / previous)


def next_events(events: DataFrame, params: Params) -> DataFrame:
    """Next earnings and ex-dividend date of each underlying, from today on.

    events: underlying_symbol, kind (earnings_info, earnings_calendar, dividend, dividend_info), event (date), is_estimated, amount, seq. An estimate
    flag counts only where the winning date came from earnings_info; an amount only from a dividend row of the winning date, the first listed.
    """
    rows = events.where(F.col("event") >= F.lit(params.today))
    earn, div = F.col("kind").startswith("earnings"), F.col("kind").startswith("dividend")
    rank = lambda first: F.struct("event", F.when(F.col("kind") == first, 0).otherwise(1), "seq")
    return rows.groupBy("underlying_symbol").agg(
        F.min(F.when(earn, F.col("event"))).alias("next_earnings_date"),
        F.min_by(F.when(F.col("kind") == "earnings_info", F.col("is_estimated")), F.when(earn, rank("earnings_info"))).alias("next_earnings_date_is_estimated"),
        F.min(F.when(div, F.col("event"))).alias("next_ex_div_date"),
        F.min_by(F.when(F.col("kind") == "dividend", F.col("amount")), F.when(div, rank("dividend"))).alias("dividend_amount"),
    )


def distinct_expirations(chain: DataFrame) -> DataFrame:
    return chain.where("expiration_date is not null").select("underlying_symbol", "expiration_date").distinct()


def daily_closes(prices: DataFrame) -> DataFrame:
    """symbol, date, close: the adjusted close where there is one."""
    return prices.select("symbol", "date", number(F.coalesce("adj_close", "close").cast("string")).alias("close")).where("close is not null")
