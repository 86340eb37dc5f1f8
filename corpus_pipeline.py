"""A training corpus from `documents` in five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm import decontaminate, jaccard, langid, pieces, suffixes
from strikeline.llm.vectors import drop_folder, passing_tables, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text without letters, or of which no language holds this share, is rejected.
LEAST_SHARE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null texts and texts without letters go; a null lang becomes the language found."""
    model = langid.train(docs)
    found = langid.identify(docs.select(*COLUMNS), model).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE))
    return _documents(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id (null last). Rows that agree in doc_id and text are one document."""
    return _documents(jaccard.one_of_each(docs.select(*COLUMNS)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand in several documents, whatever stands between the words; what a document repeats only
    within itself stays. A document of which nothing but white space is left goes."""
    found = suffixes.remove_repeats(docs.select(*COLUMNS), rule=suffixes.PASSAGES)
    return _documents(found.where((F.col("n_removed") == 0) | (F.trim(F.col("kept_text"), F.lit(" \n\t\r")) != "")).select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; a document of which nothing but white space is left goes."""
    found = decontaminate.contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    cut = found.withColumn("text", decontaminate.without_spans(F.col("text"), F.col("spans")))
    return _documents(cut.where((F.col("n_hit") == 0) | (F.trim(F.col("text"), F.lit(" \n\t\r")) != "")))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document left: doc_id, sample, ids, log_prob, perturbed, log_inclusion."""
    return pieces.encode(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sentence_pieces", sentence_pieces),
]

#: Language models and sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Results between stages stand below the shared folder of spark.checkpoint.dir; a stage's input and
    its own tables are deleted once its result is written, so the folder of the last result is what stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
