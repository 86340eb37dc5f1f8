"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; one of this machine only where none is set and all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Lists of the folders that were made while each was watched.
_watched: list[list[str]] = []


def new_folder(spark: SparkSession, ending: str = "") -> str:
    """A name in the shared folder that nothing has yet."""
    out = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}{ending}"
    for folders in _watched:
        folders.append(out)
    return out


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder, which is smaller than a checkpoint; Spark knows its size."""
    out = new_folder(df.sparkSession)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by the file system that it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are stored within, once nothing within needs them any more."""
    folders: list[str] = []
    _watched.append(folders)
    try:
        yield
    finally:
        _watched.remove(folders)
        for folder in folders:
            drop_folder(spark, folder)
