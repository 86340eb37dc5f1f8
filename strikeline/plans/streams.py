"""Queries that run over the tables as streams: what lands in the shared folder is read by Structured Streaming until all of it is done. Registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.functions.shared import new_folder
from strikeline.params import Params
from strikeline.plans import oracle, tables
from strikeline.sources import vendors
from strikeline.streaming import enrichment

PARAMS = Params()
#: Bytes of a row group of landed quotes, which is what one task of a batch reads at least.
ROW_GROUP = 4 << 20
_SCORED = "contract_symbol risk_level final_score theta_efficiency"
_NEWEST = "option_quote_time DESC, bid DESC NULLS LAST, ask DESC NULLS LAST"


def register(query, shown) -> None:
    """Adds these queries with the decorator of the registered queries."""

    @query("stream_enrichment", oracle.pick(_SCORED, "enriched"))
    def stream_enrichment(spark, sf):
        """Row columns of landed quotes, written batch by batch with a ledger."""
        folder = new_folder(spark)
        tables.chain(spark, sf).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/in")
        quotes = enrichment.read_quotes(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 4)
        enrichment.enrich_with_ledger(quotes, PARAMS, f"{folder}/out", f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
        return shown(spark.read.parquet(f"{folder}/out"), _SCORED)

    @query(
        "stream_latest_quotes",
        "WITH " + oracle.CHAIN + f""" SELECT underlying_symbol || '-' || option_type || '-' || strftime(expiration_date, '%Y-%m-%d') AS contract_symbol, strftime(option_quote_time, '%Y-%m-%d %H:%M:%S') AS option_quote_time,
  round(bid, 6) AS bid, round(ask, 6) AS ask FROM chain QUALIFY row_number() OVER (PARTITION BY underlying_symbol, option_type, chain.expiration_date ORDER BY chain.{_NEWEST}) = 1""",
    )
    def stream_latest_quotes(spark, sf):
        """The newest quote of each series, from keyed state; what a batch changed is merged by series."""
        folder = new_folder(spark)
        series = F.concat_ws("-", "underlying_symbol", "option_type", F.col("expiration_date").cast("string")).alias("contract_symbol")
        tables.chain(spark, sf).select(series, "option_quote_time", "bid", "ask").write.parquet(f"{folder}/in")
        quotes = enrichment.read_quotes(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 4)
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch_id={k}")
        latest = enrichment.latest_quotes_across_days(quotes, delay="1 day").writeStream.outputMode("update").foreachBatch(write)
        latest.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        changes = spark.read.schema(enrichment.LATEST).parquet(f"{folder}/out")
        newest = changes.groupBy("contract_symbol").agg(F.max(F.struct("option_quote_time", "bid", "ask")).alias("q"))
        return shown(newest.select("contract_symbol", "q.*"))

    @query("truthy_flags", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 <= 2 THEN true WHEN l_linenumber % 7 <= 4 THEN false END AS flag FROM lineitem")
    def truthy_flags(spark, sf):
        """Flags as other tools write them."""
        texts = F.array(*map(F.lit, ("1", " Yes", "TRUE", "0", "off", "", None)))
        line = tables.table(spark, sf, "lineitem")
        return line.select("l_orderkey", "l_linenumber", vendors.truthy(F.get(texts, (F.col("l_linenumber") % 7).cast("int"))).alias("flag"))
