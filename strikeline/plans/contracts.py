"""Queries of sources, sinks and contracts: what is written to the shared folder, read back and checked. Registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.functions.shared import new_folder
from strikeline.operators import export, ledger, positions, summaries, validation
from strikeline.params import Params
from strikeline.plans import oracle, tables
from strikeline.sources import vendors

PARAMS = Params()
_STORED = "contract_symbol underlying_symbol option_type expiration_date strike bid ask last_trade_price implied_volatility option_quote_time"


def register(query, shown) -> None:
    """Adds these queries with the decorator of the registered queries."""

    @query("snapshot_csv", oracle.pick(_STORED, "chain", oracle.CHAIN))
    def snapshot_csv(spark, sf):
        path = new_folder(spark, ".csv")
        export.write_csv(tables.chain(spark, sf), path)
        return shown(vendors.read_snapshot(spark, path), _STORED)

    @query("snapshot_parquet", oracle.pick(_STORED, "chain", oracle.CHAIN))
    def snapshot_parquet(spark, sf):
        path = new_folder(spark)
        export.write_parquet(tables.chain(spark, sf), path)
        return shown(vendors.read_snapshot(spark, path), _STORED)

    @query("landed_payload", "WITH " + oracle.CHAIN + " SELECT contract_symbol AS ticker, round(bid, 6) AS bid, strftime(expiration_date, '%Y-%m-%d') AS expiration FROM chain WHERE line % 2 = 0")
    def landed_payload(spark, sf):
        path = new_folder(spark)
        payload = F.struct("bid", F.col("expiration_date").cast("string").alias("expiration"))
        label = F.when(F.col("_line") % 2 == 0, "quotes").otherwise("profile").alias("label")
        tables.chain(spark, sf).select(F.lit("tpch").alias("provider"), F.col("contract_symbol").alias("ticker"), label, F.lit("2002-01-02T21:00:00Z").alias("fetched_at"), payload.alias("payload")).write.json(path)
        found = vendors.read_landed(spark, path, "quotes", "struct<bid: double, expiration: string>")
        return shown(found.select("ticker", "payload.bid", "payload.expiration"))

    @query(
        "positions_file",
        "SELECT s_name AS name, 'a, \"b\" ' || s_nationkey AS note, '' AS missing, CAST(3 AS BIGINT) AS cells FROM supplier",
    )
    def positions_file(spark, sf):
        """One export for each nation: blank lines, a header, quoted cells, short rows, a footer."""
        line = F.concat(F.lit(" "), "s_name", F.lit(' , "a, ""b"" '), F.col("s_nationkey").cast("string"), F.lit('"'))
        files = tables.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
        path = new_folder(spark)
        files.select("s_nationkey", F.concat(F.lit("\n\nName,Note,Missing\n\n"), "body", F.lit("\n,,\nAs of today, all rights reserved"))).write.partitionBy("s_nationkey").text(path)
        rows = vendors.read_positions(spark, path).where("line > 0")
        return shown(rows.select(F.col("cells")[0].alias("name"), F.col("cells")[1].alias("note"), F.col("cells")[2].alias("missing"), F.size("cells").alias("cells")))

    @query(
        "daily_closes",
        "SELECT o_orderkey AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2e0 ELSE o_totalprice END, 6) AS close FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0",
    )
    def daily_closes(spark, sf):
        price = F.col("o_totalprice")
        rows = tables.table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, price / 2.0).alias("adj_close"), F.when(F.col("o_orderkey") % 5 != 0, price).alias("close")
        )
        return shown(vendors.daily_closes(rows))

    @query("day_change", "WITH " + oracle.CHAIN + " SELECT contract_symbol, round(CASE WHEN bid > 0 THEN (last_trade_price - bid) / bid END, 6) AS day_change FROM chain")
    def day_change(spark, sf):
        return shown(tables.chain(spark, sf).select("contract_symbol", vendors.day_change(F.col("last_trade_price"), F.col("bid")).alias("day_change")))

    @query(
        "calendar_events",
        "WITH " + oracle.CHAIN + """, e AS (SELECT underlying_symbol, min(DATE '2001-12-20' + CAST(o % 60 AS INTEGER)) AS d FROM chain WHERE line < 5 AND DATE '2001-12-20' + CAST(o % 60 AS INTEGER) >= DATE '2002-01-02' GROUP BY 1),
d AS (SELECT underlying_symbol, min(DATE '2001-12-20' + CAST(o % 90 AS INTEGER)) AS d, max(dividend_amount) AS a FROM chain WHERE line < 4 AND DATE '2001-12-20' + CAST(o % 90 AS INTEGER) >= DATE '2002-01-02' GROUP BY 1)
SELECT coalesce(e.underlying_symbol, d.underlying_symbol) AS underlying_symbol, strftime(e.d, '%Y-%m-%d') AS next_earnings_date, CAST(NULL AS BOOLEAN) AS next_earnings_date_is_estimated,
  strftime(d.d, '%Y-%m-%d') AS next_ex_div_date, round(d.a, 6) AS dividend_amount FROM e FULL JOIN d ON e.underlying_symbol = d.underlying_symbol""",
    )
    def calendar_events(spark, sf):
        """Calendars in parts of the chain: earnings in nested arrays, some of them no dates, dividends in parallel arrays, the dates longer."""
        day = lambda k: F.date_add(F.lit("2001-12-20").cast("date"), (F.col("_order") % k).cast("int")).cast("string")
        part = F.pmod(F.xxhash64("contract_symbol"), F.lit(1 << 16)).alias("part")
        line = F.col("_line")
        packed = tables.chain(spark, sf).groupBy("underlying_symbol", part).agg(
            F.collect_list(F.when(line < 5, F.array(day(60), F.lit("soon")))).alias("earnings"), F.collect_list(F.when(line < 4, day(90))).alias("ex_date"),
            F.collect_list(F.when(line < 4, F.coalesce(F.col("dividend_amount").cast("string"), F.lit("none")))).alias("amount"),
        )
        payloads = packed.withColumn("ex_date", F.concat("ex_date", F.array(F.lit("2002-01-02"))))
        return shown(vendors.next_events(vendors.flatten_calendar(payloads, PARAMS), PARAMS))

    @query("missing_columns", "SELECT 'error' AS severity, 'missing_required_column' AS code, c AS field FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in validation.REQUIRED) + "]) AS c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE lineitem))")
    def missing_columns(spark, sf):
        return validation.missing_columns(tables.table(spark, sf, "lineitem")).select("severity", "code", "field")

    @query("empty_frame", "SELECT 'warning' AS severity, 'empty_export_frame' AS code WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_quantity < 0)")
    def empty_frame(spark, sf):
        return validation.empty_frame(tables.table(spark, sf, "lineitem").where("l_quantity < 0")).select("severity", "code")

    @query("column_metadata", "SELECT column_name AS name, column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%' AS is_numeric FROM (DESCRIBE orders)")
    def column_metadata(spark, sf):
        return spark.createDataFrame(summaries.column_metadata(tables.table(spark, sf, "orders")), "name string, is_numeric boolean")

    _broken = "WITH f AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS contract_symbol FROM lineitem WHERE l_discount = 0) SELECT contract_symbol, 'bid' AS field FROM f ORDER BY 1 LIMIT 3"

    @query("ranked_findings", _broken)
    def ranked_findings(spark, sf):
        """The first three rows of a discount of 0, which stands for an invalid bid."""
        full = {c: F.lit("1") for c in validation.REQUIRED} | {"option_type": F.lit("put"), "expiration_date": F.lit("2002-01-02"), "ask": F.lit("2"), "bid": F.when(F.col("l_discount") == 0, "-1").otherwise("1")}
        full["contract_symbol"] = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        raw = tables.table(spark, sf, "lineitem").select(*(x.alias(c) for c, x in full.items()))
        found = validation.row_findings(raw).where("code = 'invalid_bid'")
        return validation.ranked_findings(found, 3).select("contract_symbol", "field")

    _hashed = "contract_symbol underlying_symbol option_type expiration_date strike"
    _row_text = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _hashed.split())
    _hash_sql = "WITH " + oracle.CHAIN + f", h AS (SELECT sha256({_row_text}) AS h FROM chain) SELECT count(*) AS row_count, " + " || '-' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {k}, 15) AS BIGINT)), 0) AS VARCHAR)" for k in (1, 16)) + " AS content_hash FROM h"

    @query("snapshot_hash", _hash_sql)
    def snapshot_hash(spark, sf):
        """Row count and content hash of a stored snapshot, as they stand in its ledger row."""
        path = new_folder(spark)
        export.write_parquet(tables.chain(spark, sf), path)
        return ledger.content_hash(vendors.read_snapshot(spark, path).select(*_hashed.split()))

    @query("snapshot_contract", "SELECT 'schema_version' AS problem, count(*) AS rows FROM lineitem UNION ALL SELECT 'row_count', count(*) FROM lineitem")
    def snapshot_contract(spark, sf):
        """A stored snapshot against a ledger row of another version and a row count that is one too high; the hash is that of the rows before they were stored."""
        path = new_folder(spark)
        chain = tables.chain(spark, sf)
        export.write_parquet(chain, path)
        stored = vendors.read_snapshot(spark, path)
        entry = ledger.content_hash(export.conform(chain).select(*_hashed.split())).select(F.lit(1).alias("schema_version"), (F.col("row_count") + 1).alias("row_count"), "content_hash")
        problems = ledger.check_snapshot(stored.select(*_hashed.split()), entry, 2)
        return problems.select("problem", (F.col("ledger_rows") - 1).alias("rows"))

    _key = "concat_ws('|', kind, ticker, coalesce(strftime(expiration_date, '%Y-%m-%d'), ''), coalesce(option_type, ''), coalesce(CAST(strike AS VARCHAR), ''))"
    _sums = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {k}, 15) AS BIGINT)), 0) AS VARCHAR)" for k in (1, 16, 31, 46))

    @query("positions_fingerprint", "WITH " + oracle.CHAIN + oracle.ALL_POSITIONS + f", hashed AS (SELECT DISTINCT sha256({_key}) AS h FROM positions) SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_sums})) AS fingerprint FROM hashed")
    def positions_fingerprint(spark, sf):
        return ledger.positions_fingerprint(positions.parse_positions(tables.raw_positions(spark, sf, every=True)))
