"""Chains, positions, closes, events and a ledger made from TPC-H-like tables, so that every operator has data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.functions.sqlx import d, time
from strikeline.params import Params


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table that is read in fewer parts than there are cores, as a file of one row group is, dealt out by keys; larger ones are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _before(as_of: str, seconds: str) -> str:
    return f"timestamp_micros(unix_micros({as_of}) - 1000000L * {seconds})"


def chain(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    """One contract per line item; brand gives the underlying, part the tenor, supplier the strike."""
    columns = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_returnflag l_discount l_quantity l_linestatus l_tax".split()
    line = spread(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey")
    line = line.join(table(spark, sf_dir, "part").selectExpr("p_partkey", "int(substring(p_brand, 7, 4)) AS n"), F.col("l_partkey") == F.col("p_partkey"))
    as_of, today = time(params.as_of), f"DATE'{params.today.isoformat()}'"
    price, dte, age = "floor(l_extendedprice / 100D)", "int(7 * (l_partkey % 13))", "((l_orderkey * 37 + l_suppkey * 11) % 30000)"
    return line.selectExpr(
        f"{today} AS snapshot_date", "concat('TK', chr(64 + n)) AS underlying_symbol", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS contract_symbol",
        "IF(l_linestatus = 'O', 'call', 'put') AS option_type", f"date_add({today}, {dte}) AS expiration_date", f"{dte} AS days_to_expiration", f"{dte} / 365D AS time_to_expiration_years",
        "(2.5D + 0.5D * n) * (10 + l_suppkey % 21) AS strike", "50D + 10D * n AS underlying_price", "(n - 13) / 500D AS underlying_day_change_pct",
        "0.2D + n / 100D AS historical_volatility", f"{_before(as_of, '(n * 900)')} AS underlying_price_time",
        "double(n * 900) AS underlying_price_age_seconds", f"n * 900 > {params.stale_quote_seconds} AS is_stale_underlying_price",
        f"date_add({today}, 3 * n) AS next_earnings_date", "n % 2 = 0 AS next_earnings_date_is_estimated", "3 * n AS days_to_earnings",
        f"IF(n % 5 <> 0, date_add({today}, 2 * n), NULL) AS next_ex_div_date", "IF(n % 5 <> 0, 2 * n, NULL) AS days_to_ex_div", "IF(n % 5 <> 0, n / 10D, NULL) AS dividend_amount",
        f"CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL WHEN l_discount = 0 THEN 0D ELSE {price} / 100D END AS bid",
        f"IF(l_linenumber = 6 AND l_returnflag = 'R' AND l_quantity < 5, ({price} - 1D) / 100D, floor({price} * (1D + 4D * l_discount)) / 100D) AS ask",
        f"IF(l_returnflag = 'R' AND l_linenumber = 1, NULL, ({price} + l_linenumber) / 100D) AS last_trade_price",
        "bigint(l_quantity) AS volume", "bigint(l_quantity * l_linenumber * 4) AS open_interest", "IF(l_tax = 0, NULL, 0.1D + 5D * l_tax + 0.02D * l_linenumber) AS implied_volatility",
        f"{_before(as_of, age)} AS option_quote_time", "'tpch' AS data_source", f"{d(params.risk_free_rate)} AS risk_free_rate_used",
        "l_orderkey AS _order", "l_linenumber AS _line", "n AS _n",
    )


def raw_positions(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """A Symbol column: held options at strikes within and beyond the tolerance, held stocks, cash and pending rows; of a portfolio that holds
    some of the contracts, or of all of them."""
    c = chain(spark, sf_dir)
    if not every:
        c = c.where("_order % 97 = 0")
    strike = F.format_string("%.3f", F.col("strike") + F.when(F.col("_line") % 2 == 0, 0.005).otherwise(0.02))
    option = F.concat(F.lit(" -"), "underlying_symbol", F.date_format("expiration_date", "yyMMdd"), F.when(F.col("option_type") == "call", "C").otherwise("P"), strike)
    stock = F.when(F.col("_n") % 3 == 0, F.col("underlying_symbol")).when(F.col("_n") % 3 == 1, "SPAXX**").otherwise("Pending activity")
    return c.select(F.explode(F.array(option, stock)).alias("Symbol"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def underlyings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per underlying: its snapshot and events."""
    fields = (
    "underlying_price", "underlying_price_time", "underlying_day_change_pct", "historical_volatility", "next_earnings_date",
    "next_earnings_date_is_estimated", "next_ex_div_date", "dividend_amount",
)
    return chain(spark, sf_dir).groupBy("underlying_symbol").agg(*(F.max(c).alias(c) for c in fields))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of runs from the events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("dataset_id"), F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("created_at"))
