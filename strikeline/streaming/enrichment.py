"""Continuous enrichment and the latest quote of each contract, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strikeline.operators.ledger import hash_totals, row_hash
from strikeline.params import Params
from strikeline.plans.enrich import enrich_rows
from strikeline.plans.tables import spread

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
LEDGER = "row_count long, content_hash string, first_date date, last_date date, batch_id int"
#: Snapshot dates that a task may have open files of at once; rows of more are sorted by date.
OPEN_DATES = 4


@contextmanager
def unsorted(spark: SparkSession) -> Iterator[None]:
    """Rows are written below their dates as they come, where a task has few dates; else Spark sorts them first, which spills wide rows."""
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, OPEN_DATES)
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def read_quotes(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Newly landed Parquet files of quotes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def enrich_stream(quotes: DataFrame, params: Params, out: str, checkpoint: str) -> StreamingQuery:
    """Row-level columns of every new quote, appended to a Parquet folder; the same functions as in batch."""
    return enrich_rows(quotes, params).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_batch(quotes: DataFrame, batch: int, params: Params, out: str, ledger: str) -> None:
    """One batch of quotes, enriched, below snapshot_date and batch_id, and its ledger row (batch_id, row_count, content_hash, snapshot dates).

    Both writes replace what the same batch wrote before and nothing else, so a batch that is run again changes nothing. The ledger row comes last: rows without one
    are of a batch that did not end. Rows are counted and hashed as they are written, below their dates as they come: wide rows are not read back and not sorted.
    """
    spark = quotes.sparkSession
    replace = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    rows = enrich_rows(spread(quotes, "contract_symbol"), params, settled=False, packed=True)
    rows = rows.select(*(c for c in rows.columns if c != "snapshot_date"), "snapshot_date")  # in the order of a stored row, which its hash follows
    seen = Observation()
    totals = [*hash_totals(row_hash(rows.schema)), F.min("snapshot_date").alias("first_date"), F.max("snapshot_date").alias("last_date")]
    with unsorted(spark):
        replace(rows.withColumn("batch_id", F.lit(batch)).observe(seen, *totals), "snapshot_date", "batch_id").parquet(out)
    entry = spark.createDataFrame([{**seen.get, "batch_id": batch}], LEDGER)
    replace(entry.coalesce(1), "batch_id").parquet(ledger)


def enrich_with_ledger(quotes: DataFrame, params: Params, out: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Every batch of new quotes by write_batch."""
    return quotes.writeStream.foreachBatch(lambda df, k: write_batch(df, k, params, out, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_quotes(quotes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Quotes without the repeats that arrive within the delay."""
    return quotes.withWatermark("option_quote_time", delay).dropDuplicatesWithinWatermark(["contract_symbol", "option_quote_time"])


def latest_quotes(quotes: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The newest quote of each contract in each window of time; later quotes than the delay are late. State holds one quote per contract and
    open window."""
    value = F.struct("option_quote_time", "bid", "ask")
    timed = quotes.withWatermark("option_quote_time", delay)
    best = timed.groupBy(F.window("option_quote_time", window), "contract_symbol").agg(F.max_by(value, F.struct("option_quote_time", "bid", "ask")).alias("q"))
    return best.select("contract_symbol", F.col("window.start").alias("window_start"), "q.*")


LATEST = "contract_symbol string, option_quote_time timestamp, bid double, ask double"


def _newest(quotes: pd.DataFrame) -> tuple[int, float | None, float | None]:
    """Microseconds, bid and ask of the newest quote; of equal times the greater bid, then ask, missing ones least, as in a batch."""
    last = quotes.sort_values(["option_quote_time", "bid", "ask"], na_position="first").iloc[-1]
    plain = lambda x: None if pd.isna(x) else float(x)
    return last["option_quote_time"].value // 1000, plain(last["bid"]), plain(last["ask"])


def _rank(q: tuple[int, float | None, float | None]) -> tuple:
    low = float("-inf")
    return q[0], low if q[1] is None else q[1], low if q[2] is None else q[2]


def latest_quotes_across_days(quotes: DataFrame, delay: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """A row for each contract whose newest quote has changed, to be merged by contract (update mode).

    State holds one quote of each contract, whatever the number of snapshots, and is dropped once the watermark has passed that quote by `idle`. Quotes older than the
    watermark are late and left out; they could be no contract's newest unless it had no quote since.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        now = max(([before] if before else []) + [_newest(p) for p in parts if len(p)], key=_rank)
        state.update(now)
        state.setTimeoutTimestamp(max(now[0] // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        if before is None or _rank(now) > _rank(before):
            at = pd.to_datetime([now[0]], unit="us", utc=True).tz_localize(None)
            yield pd.DataFrame({"contract_symbol": [key[0]], "option_quote_time": at, "bid": [now[1]], "ask": [now[2]]})

    timed = quotes.where("option_quote_time IS NOT NULL").select("contract_symbol", "option_quote_time", F.col("bid").cast("double"), F.col("ask").cast("double")).withWatermark("option_quote_time", delay)
    return timed.groupBy("contract_symbol").applyInPandasWithState(step, LATEST, "at long, bid double, ask double", "update", GroupStateTimeout.EventTimeTimeout)
