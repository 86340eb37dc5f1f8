"""The canonical export: columns, formats and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.schema import COLUMNS, TIMESTAMPS, type_of

CSV_ROWS = 500_000
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def canonical(df: DataFrame, c: str) -> str:
    return f"CAST({f'`{c}`' if c in df.columns else 'NULL'} AS {type_of(c).simpleString()}) AS `{c}`"


def conform(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns in order and of canonical types; extra columns go, absent ones are missing values."""
    return df.selectExpr(*(canonical(df, c) for c in COLUMNS))


def format_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps as UTC text, for text sinks; the session's zone is UTC."""
    return df.withColumns({c: F.date_format(c, TIMESTAMP_FORMAT) for c in TIMESTAMPS if c in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; missing values are blank. Gzip, in files of at most CSV_ROWS rows, each of which is read by one task."""
    format_timestamps(conform(df)).write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", CSV_ROWS).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """A snapshot, typed, one folder per snapshot date; a rerun of a date replaces that date only."""
    rows = df.selectExpr(*(canonical(df, c) for c in COLUMNS), "snapshot_date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """A snapshot as a table of the session's catalogue, bucketed and sorted by underlying: what groups or joins by underlying reads it without an exchange."""
    rows = df.selectExpr(*(canonical(df, c) for c in COLUMNS), "snapshot_date")
    rows.write.mode("overwrite").bucketBy(buckets, "underlying_symbol").sortBy("underlying_symbol").format("parquet").saveAsTable(table)


def union_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is missing there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
