"""Queries over the snapshot ledger: one row per stored snapshot, with provider and created_at."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.params import Params

NEWEST = ("created_at", "dataset_id")


def list_snapshots(ledger: DataFrame, provider: str | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None, limit: int = 50) -> DataFrame:
    """Newest first; bounds are inclusive."""
    for value, test in ((provider, F.col("provider") == provider), (since, F.col("created_at") >= F.lit(since)), (until, F.col("created_at") <= F.lit(until))):
        if value is not None:
            ledger = ledger.where(test)
    return ledger.orderBy(*(F.desc(c) for c in NEWEST)).limit(limit)


def latest_snapshot(ledger: DataFrame) -> DataFrame:
    return list_snapshots(ledger, limit=1)


def runs_today(ledger: DataFrame, params: Params) -> DataFrame:
    """Runs of each provider since midnight of the market's day."""
    day = F.to_date(F.from_utc_timestamp("created_at", params.market_zone))
    return ledger.where(day == F.lit(params.today)).groupBy("provider").agg(F.count("*").alias("runs"))


def retention_candidates(ledger: DataFrame, keep: int) -> DataFrame:
    """Snapshots beyond the newest `keep` of each provider; 0 keeps all.

    Spark takes the newest `keep` of each provider before the shuffle too; the oldest of them is what rows are then held against, so no task has all rows of one.
    """
    if not keep:
        return ledger.limit(0)
    w = Window.partitionBy("provider").orderBy(*(F.desc(c) for c in NEWEST))
    age = F.struct(*NEWEST)
    newest = ledger.select("provider", *NEWEST).withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep)
    last = newest.groupBy(F.col("provider").alias("_provider")).agg(F.min(age).alias("_last"), F.count("*").alias("_n")).where(F.col("_n") == keep)
    return ledger.join(last, ledger["provider"].eqNullSafe(last["_provider"]) & (age < last["_last"])).drop("_provider", "_last", "_n")


#: Their texts are ASCII, so the length is that in bytes, which needs no pass over the text.
_ASCII = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Lengths of all such texts but those of decimals, with the colon: taken from here, none is made anew for each value.
_LENGTHS = f"array({', '.join(f"'{n}:'" for n in range(32))})"


def _text(field: T.StructField) -> list[str]:
    """Length, colon and value, or - for a missing one: parts of one flat concat, which copies each value once."""
    name, kind = f"`{field.name}`", field.dataType
    text = f"CASE WHEN {name} THEN 'true' WHEN NOT {name} THEN 'false' END" if isinstance(kind, T.BooleanType) else f"CAST({name} AS STRING)"
    if isinstance(kind, _ASCII) and not isinstance(kind, T.DecimalType):
        return [f"coalesce(get({_LENGTHS}, octet_length({text})), '-')", f"coalesce({text}, '')"]
    length = "octet_length" if isinstance(kind, _ASCII) else "char_length"
    return [f"coalesce(CAST({length}({text}) AS STRING), '-')", f"IF({name} IS NULL, '', ':')", f"coalesce({text}, '')"]


def row_hash(schema: T.StructType) -> Column:
    """SHA-256 of a row's text, which has the length of each value before it, and - for a missing one."""
    return F.expr(f"sha2(concat({', '.join(x for f in schema.fields for x in _text(f))}), 256)")


def hash_totals(h: Column) -> list[Column]:
    """Row count and content hash, as aggregates of the hash of each row. A part is added up in three pieces of 20 bits, as whole numbers, exactly for 2^43 rows."""
    sums = []
    for k in (1, 16):
        part = F.conv(F.substring(h, k, 15), 16, 10).cast("bigint")
        pieces = (F.coalesce(F.sum(F.shiftright(part, n).bitwiseAND(F.lit((1 << 20) - 1))), F.lit(0)).cast("decimal(19,0)") * F.lit(1 << n).cast("decimal(13,0)") for n in (40, 20, 0))
        sums.append(sum(pieces, F.lit(0)).cast("string"))
    return [F.count("*").alias("row_count"), F.concat_ws("-", *sums).alias("content_hash")]


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and a hash of the multiset of rows: sums of two 60-bit parts of each row's SHA-256. It does not depend on the order of rows or partitions, and rows that
    stand twice do not cancel."""
    return df.select(row_hash(df.schema).alias("h")).agg(*hash_totals(F.col("h")))


def check_snapshot(df: DataFrame, entry: DataFrame, schema_version: int) -> DataFrame:
    """Problems (schema_version, row_count, content_hash) of a stored snapshot against its ledger row, a frame of one row, with the row's count as ledger_rows."""
    named = entry.select(F.col("schema_version").alias("_version"), F.col("row_count").alias("ledger_rows"), F.col("content_hash").alias("_hash"))
    both = content_hash(df).join(named, F.lit(True), "left")  # one row each
    tests = [
        F.when(~F.col("_version").eqNullSafe(F.lit(schema_version)), "schema_version"),
        F.when((F.col("row_count") == 0) | ~F.col("row_count").eqNullSafe(F.col("ledger_rows")), "row_count"),
        F.when(~F.col("content_hash").eqNullSafe(F.col("_hash")), "content_hash"),
    ]
    return both.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem"), "ledger_rows")


def positions_fingerprint(positions: DataFrame) -> DataFrame:
    """A SHA-256 of the set of position keys, whatever their order: of their number and of the sums of the parts of their own SHA-256."""
    key = F.concat_ws("|", "kind", "ticker", F.coalesce(F.col("expiration_date").cast("string"), F.lit("")), F.coalesce("option_type", F.lit("")), F.coalesce(F.col("strike").cast("string"), F.lit("")))
    hashed = positions.select(F.sha2(key, 256).alias("h")).distinct()
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in (1, 16, 31, 46)]
    return hashed.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))
