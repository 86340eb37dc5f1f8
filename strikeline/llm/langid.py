"""Language identification by mixture inference.

Every language has a hashed byte-trigram model, counted over the text of all its training documents. A document is a mixture: expectation-
maximisation over its words estimates the share of each language, and languages enter the mixture one by one while the gain in log-likelihood exceeds a
penalty that grows with the logarithm of the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import chunks, per_group, short_batches, utf8

UND = "und"
BUCKETS = 1 << 16
#: Log-likelihood that a further language must gain, times the logarithm of the number of words.
PENALTY = 6.0
ROUNDS = 8

#: Lower-case letters and bytes of non-ASCII characters stay, everything else is a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def _grams(buf: np.ndarray, off: np.ndarray):
    """Trigram bucket at each byte of the text, folded and with a space around each row; word starts, word ends and rows in that text."""
    n = len(off) - 1
    text = np.full(len(buf) + n + 2, 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(off)) + 1] = FOLD[buf]
    inside = text != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    row = np.searchsorted(off[1:] + np.arange(1, n + 1), start, "right")
    t = text.astype(np.uint32)
    gram = t[:-2] | (t[1:-1] << np.uint32(8)) | (t[2:] << np.uint32(16))
    return (gram * np.uint32(2654435761)) >> np.uint32(16), start, end, row


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram bucket in each, from all rows that have a language.

    Counts are summed in the tasks and then by language in two steps; the driver gets one vector of fixed length per language. The model takes 256 KB
    for each different label, and training twice that: a column of thousands of labels that are no languages is to be cleaned first.
    """
    short_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            buf, off = utf8(batch.column("text"))
            gram, *_ = _grams(buf, off)
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), str), return_inverse=True)
            of = np.repeat(code, np.diff(off) + 1)
            found = np.bincount(of * BUCKETS + gram, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for lang, counts in zip(names.tolist(), found, strict=True):
                sums[lang] = sums.get(lang, 0) + counts
        if sums:
            salt = TaskContext.get().partitionId() % 16
            yield pa.RecordBatch.from_arrays([pa.array([f"{salt:02d}{k}" for k in sums]), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], names=["k", "v"])

    def add(table: pa.Table) -> pa.RecordBatch:
        total = np.zeros(BUCKETS, np.int64)
        for v in table.column("v"):
            total += np.frombuffer(v.as_py(), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([table.column("k")[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    part = per_group(rows.mapInArrow(count, "k string, v binary"), "k", add, "k string, v binary")
    whole = per_group(part.select(F.substring("k", 3, 1 << 20).alias("k"), "v"), "k", add, "k string, v binary", 1)
    found = sorted((r.k, np.frombuffer(r.v, np.int64)) for r in whole.collect())
    if not found:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([v for _, v in found], 1).astype(np.float64) + 0.1
    return [k for k, _ in found], np.log(counts / counts.sum(0)).astype(np.float32)


def _em(p: np.ndarray, share: np.ndarray, first: np.ndarray, row: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document after some rounds from the given ones, and the log of the mixture's likelihood, to which the shift is to be added."""
    for _ in range(rounds):
        g = p * share[row]
        g /= g.sum(1, keepdims=True)
        share = np.add.reduceat(g, first, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((p * share[row]).sum(1)), first)


def mixture(ll: np.ndarray, first: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the languages in each document. ll: log-likelihood of each word under each language; first: each document's first word."""
    n = np.diff(np.append(first, len(ll)))
    row = np.repeat(np.arange(len(first)), n)
    shift = ll.max(1, keepdims=True)
    p = np.maximum(np.exp(ll - shift), 1e-30)
    alone = np.add.reduceat(ll - shift, first, axis=0)
    start, _ = _em(p, np.full((len(first), ll.shape[1]), 1 / ll.shape[1], np.float32), first, row, n, 2)
    start[np.arange(len(first)), alone.argmax(1)] = 2  # the best language alone comes first
    order = np.argsort(-start, axis=1, kind="stable")
    share = np.zeros_like(start)
    share[np.arange(len(first)), order[:, 0]] = 1
    best, live = alone.max(1), np.arange(len(first))
    for k in range(2, ll.shape[1] + 1):
        words = np.isin(row, live) if len(live) < len(first) else slice(None)
        own_n = n[live]
        own_first = np.cumsum(own_n) - own_n
        init = np.zeros((len(live), ll.shape[1]), np.float32)
        np.put_along_axis(init, order[live, :k], np.float32(1 / k), 1)
        found, value = _em(p[words], init, own_first, np.repeat(np.arange(len(live)), own_n), own_n, rounds)
        better = value - best[live] > penalty * np.log(own_n + 1)
        live = live[better]
        if not len(live):
            break
        share[live], best[live] = found[better], value[better]
    return share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The language mixture of every text.

    Returns one row per row of docs, in no order: all columns of docs, then lang_pred, score (share of lang_pred, 0 to 1) and lang_shares
    (map of the selected languages). Texts that are null, empty or without letters, and any text where no language was learned, are `und` with score
    0. Ties go to the language first in alphabetical order.
    """
    short_batches(docs.sparkSession)
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "lang_shares")]
    own = docs.select(*[docs[f"`{f.name}`"] for f in fields])
    schema = T.StructType([*own.schema.fields]).add("lang_pred", "string").add("score", "double").add("lang_shares", T.MapType(T.StringType(), T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in chunks(batches, text_col):
            buf, off = utf8(batch.column(text_col))
            n = len(batch)
            share = np.zeros((n, len(names)), np.float32)
            gram, start, end, row = _grams(buf, off)
            if len(start) and names:
                # the trigrams of a word begin at the byte before it and end at the byte after it
                edges = np.stack([start - 1, np.minimum(end - 1, len(gram))], 1).ravel()
                ll = np.stack([np.add.reduceat(np.append(log_p[gram, k], np.float32(0)), edges)[::2] for k in range(len(names))], 1)
                docs_with = np.unique(row)
                share[docs_with] = mixture(ll, np.searchsorted(row, docs_with), penalty)
                ascii_letter = np.zeros(256, bool)
                ascii_letter[65:91] = ascii_letter[97:123] = True
                sums = np.concatenate([[0], np.cumsum(ascii_letter[buf])])
                for i in np.flatnonzero((sums[off[1:]] == sums[off[:-1]]) & (np.diff(off) > 0)):
                    if not _has_letter(batch.column(text_col)[int(i)].as_py()):
                        share[i] = 0
            top = share.argmax(1) if names else np.zeros(n, int)
            score = share[np.arange(n), top].astype(float) if names else np.zeros(n)
            none = score <= 0
            pred = [UND if e else names[k] for e, k in zip(none, top, strict=True)]
            maps = [[(names[k], float(s[k])) for k in np.flatnonzero(s > 0)] for s in share]
            extra = [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score", "lang_shares"])

    return own.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_shares")
