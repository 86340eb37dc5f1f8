"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (runs without white space), weighted by their number. For each of K samples a term of weight w draws r, c ~ Gamma(2, 1) and
b ~ Uniform(0, 1) from its hash; with t = floor(ln w / r + b) and y = exp(r (t - b)), the term of the least a = c / (y exp(r)) is sampled together with t.
Two texts agree in a sample with a probability that equals their generalised Jaccard similarity, the sum of the lesser weights over that of the greater.
A fingerprint holds 16 bits of each sample; likeness corrects for their chance agreement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import SPACE, U, chunks, mix, prefix_hash, short_batches, span_hash, utf8, word_spans

SAMPLES = 128
#: Bytes of text that a task fingerprints at a time, terms whose draws are held at once, and rows of draws that are in the processor's cache.
BATCH_BYTES, TERMS, DRAW_ROWS, MIN_ROWS = 2 << 20, 1 << 16, 256, 4096
#: Bytes of text of a run of neighbouring documents, at most and at least; runs that a task should get; documents that are sampled for each run.
RUN_BYTES, LEAST_BYTES, RUNS_A_TASK, SAMPLED = 256 << 20, 4 << 20, 4, 8


def _draws(terms: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For each term of a weight and each sample: ln a as an ordered integer in the high 32 bits, a hash of (term, t) in the low."""
    seed = mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    x = terms[:, None] ^ seed[None, :]
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(29)
    y = x * U(0xD6E8FEB86659FD93)
    y ^= y >> U(32)
    uniform = lambda bits, n: (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-n)
    r = -np.log(uniform(x & U(0xFFFFF), 20) * uniform((x >> U(20)) & U(0xFFFFF), 20))
    ln_c = np.log(-np.log(uniform(x >> U(40), 24) * uniform(y >> U(40), 24)))
    b = uniform((y >> U(16)) & U(0xFFFFFF), 24)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    ln_a = ln_c - r * (t - b) - r
    bits = ln_a.view(np.uint32)
    ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U)
    low = (y + t.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)) * U(0xBF58476D1CE4E5B9)
    return (ordered << U(32)) | (low >> U(32))


def signatures(buf: np.ndarray, off: np.ndarray, k: int = SAMPLES) -> np.ndarray:
    """A row of k 16-bit samples for each text; a text without words has zeros. Draws are made once for each term and weight of the batch."""
    n = len(off) - 1
    start, end, row = word_spans(buf, off, ~SPACE)
    out = np.zeros((n, k), np.uint16)
    if not len(start):
        return out
    h = span_hash(prefix_hash(buf), start, end)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    h, row = h[at], row[at]
    _, one, own = np.unique(mix(h + weight.astype(U) * U(0x632BE59BD9B4E019)), return_index=True, return_inverse=True)
    least = np.full((n, k), np.iinfo(np.uint64).max, U)
    for lo in range(0, len(one), TERMS):  # a part of the terms at a time, each text's least draw over all parts
        some = one[lo : lo + TERMS]
        table = np.empty((len(some), k), U)
        for a in range(0, len(some), DRAW_ROWS):
            i = some[a : a + DRAW_ROWS]
            table[a : a + DRAW_ROWS] = _draws(h[i], weight[i], k)
        mine = np.flatnonzero((own >= lo) & (own < lo + len(some))) if len(one) > TERMS else np.arange(len(own))
        for a in range(0, len(mine), MIN_ROWS):
            at = mine[a : a + MIN_ROWS]
            rows = row[at]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            least[rows[first]] = np.minimum(least[rows[first]], np.minimum.reduceat(table[own[at] - lo], first, axis=0))
    have = np.unique(row)
    out[have] = (least[have] & U(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimate of the generalised Jaccard similarity from two arrays of signatures."""
    same = (a == b).mean(-1)
    chance = 1 / 65536
    return np.clip((same - chance) / (1 - chance), 0, 1)


def fingerprints(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """All columns of docs and `fingerprint`, 4 hex digits per sample. Null texts count as empty, whose fingerprint is all zeros; equal texts
    have equal fingerprints; other columns pass unchanged (one named fingerprint is replaced)."""
    short_batches(docs.sparkSession)
    own = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, BATCH_BYTES):
            buf, off = utf8(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes().hex() for s in signatures(buf, off, samples)], pa.string())], names=[*batch.schema.names, "fingerprint"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add("fingerprint", "string"))


def _place() -> tuple[Column, ...]:
    """The columns that place a document; a nullable number would reach pandas as a float."""
    return F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("name")


def _order(ids: np.ndarray, null: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that ascend in the order of documents: descending id, null last, then the hash of the text."""
    x = np.uint64(1 << 63) - ids.astype(np.int64).view(np.uint64) - np.uint64(1)
    most = np.iinfo(np.uint64).max
    return np.where(null.astype(bool), most, np.minimum(x, most - np.uint64(1))), names.astype(np.int64)


class Runs:
    """Where runs of documents begin, as sorted pairs of numbers; a document before the first of them is in run 0."""

    def __init__(self, ids: np.ndarray, names: np.ndarray) -> None:
        self.ids, self.names = ids, names

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        run, last = np.searchsorted(self.ids, x, "left"), np.searchsorted(self.ids, x, "right")
        for k in np.unique(run[run < last]):  # ids at which a run begins
            own = (run == k) & (last > k)
            run[own] = k + np.searchsorted(self.names[k : last[own][0]], y[own], "right")
        return run.astype(np.int32)


def _runs(docs: DataFrame) -> tuple[Runs, dict[int, tuple[int, int]]]:
    """Runs of documents, of at most about RUN_BYTES of text, smaller where tasks would have none; and the first document of each run.

    Cuts are taken from a sample of ids and text hashes, as a sort does; the driver holds some numbers for each run, that is for each RUN_BYTES of
    text. An id on many rows is cut by the hash of its texts.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text")).cast("long")).first()
    size = size or 0
    tasks = RUNS_A_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(rows, max(size // RUN_BYTES, min(size // LEAST_BYTES, tasks))))
    cuts = Runs(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if parts > 1:
        sample = docs.select(*_place()).sample(min(1.0, SAMPLED * parts / rows), 1).collect()
        x, y = _order(*(np.array(c) for c in zip(*sample, strict=True))) if sample else (cuts.ids, cuts.names)
        order = np.lexsort((y, x))
        at = order[np.linspace(0, len(order), parts, endpoint=False).astype(int)[1:]] if len(order) else order
        pairs = np.unique(np.stack([x[at].view(np.int64), y[at]], 1), axis=0)
        x, y = pairs[:, 0].view(np.uint64), pairs[:, 1]
        order = np.lexsort((y, x))
        cuts = Runs(x[order], y[order])

    @F.pandas_udf("run int, x long, y long")
    def placed(ids: pd.Series, null: pd.Series, names: pd.Series) -> pd.DataFrame:
        x, y = _order(ids.to_numpy(), null.to_numpy(), names.to_numpy())
        # the order of x as a signed number
        return pd.DataFrame({"run": cuts.of(x, y), "x": (x ^ np.uint64(1 << 63)).view(np.int64), "y": y})

    firsts = docs.select(placed(*_place()).alias("p")).groupBy("p.run").agg(F.min(F.struct("p.x", "p.y")).alias("first"))
    return cuts, {r.run: (r.first.x, r.first.y) for r in firsts.select("run", "first").collect()}


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; and the likeness to the next text.

    The next document follows in descending doc_id (null last; documents of one id by a hash of their texts); after the last comes the first. The edited text
    has its last floor(n/3) of n code points replaced by the first as many (or all) of the next. Null texts count as empty; a single document is its own next;
    rows that repeat a doc_id are each answered; an empty table gives no rows; other columns are ignored.

    Documents are dealt by runs, and each run also gets the first document of the next run, so every text crosses one shuffle and no task holds
    more than a batch.
    """
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("name"))
    cuts, first = _runs(own)
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}
    heads = np.array(sorted(x for x, _ in before), np.int64)

    @F.pandas_udf("array<struct<run:int,extra:boolean>>")
    def places(ids: pd.Series, null: pd.Series, names: pd.Series) -> pd.Series:
        x, y = _order(ids.to_numpy(), null.to_numpy(), names.to_numpy())
        run = cuts.of(x, y)
        x = (x ^ np.uint64(1 << 63)).view(np.int64)
        out = [[(b, False)] for b in run.tolist()]
        for i in np.flatnonzero(np.isin(x, heads)).tolist():
            if (own := before.get((int(x[i]), int(y[i])))) is not None:
                out[i].append((own, True))
        return pd.Series(out)

    dealt = own.select("doc_id", "text", "name", F.explode(places(*_place())).alias("p")).select("p.run", "p.extra", "doc_id", "name", "text")
    ordered = dealt.repartition("run").sortWithinPartitions("run", "extra", F.col("doc_id").desc_nulls_last(), "name", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def flush(ids: list, texts: list[str], closing: str) -> pa.RecordBatch:
        following = [*texts[1:], closing]
        cut = [len(t) // 3 for t in texts]
        edited = [t[: len(t) - c] + f[:c] for t, f, c in zip(texts, following, cut, strict=True)]
        n = len(texts)
        both = signatures(*utf8(pa.array([*texts, closing, *edited], pa.large_string())), samples)
        sig, other = both[: n + 1], both[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([s.tobytes().hex() for s in sig[:n]]), pa.array([s.tobytes().hex() for s in other]),
                pa.array(likeness(sig[:n], other)), pa.array(likeness(sig[:n], sig[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, at, done = 0, None, False
        head = ""
        for batch in batches:
            for b, extra, i, t in zip(*(batch.column(c).to_pylist() for c in ("run", "extra", "doc_id", "text")), strict=True):
                if b != at:
                    if ids and not done:  # no further run: only where there is a single one
                        yield flush(ids, texts, head)
                    ids, texts, size, at, done, head = [], [], 0, b, False, t
                if done:
                    continue
                if extra:
                    yield flush(ids, texts, t)
                    ids, texts, done = [], [], True
                    continue
                if size + len(t) > BATCH_BYTES and ids:
                    yield flush(ids, texts, t)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids and not done:
            yield flush(ids, texts, head)

    return ordered.mapInArrow(run, schema)


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
