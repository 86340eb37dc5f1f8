"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by hashed byte trigrams (as they are, and by the kind of each byte) and a learned
layer; gated attention, softmax of w (tanh(V h) * sigmoid(U h)), weighs the passages, and a logistic layer scores the weighted sum.
The layers are learned together from document labels alone, on a sample of labelled documents of at most SAMPLE documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import SPACE, chunks, short_batches, utf8, word_spans

PASSAGE_WORDS = 64
RAW, KINDS = 256, 256
HIDDEN, GATE = 24, 16
#: Bound of the labelled sample (whole documents, those of the least hash of doc_id) and passes over it.
SAMPLE, EPOCHS = 3000, 40
#: Documents that a step learns from, and bytes of their texts; a longer document is a step of its own.
BATCH, BATCH_BYTES = 64, 1 << 20
THRESHOLD = 0.3

_KIND = np.arange(256, dtype=np.uint32)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 97, 65, 48, 200


def _hashed(x: np.ndarray, seed: int, buckets: int) -> np.ndarray:
    x = x.astype(np.uint32)
    g = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35) + np.uint32(seed)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    return (g >> np.uint32(12)) % np.uint32(buckets)


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages (square roots of trigram frequencies) and the row of each; every row has one at least."""
    n = len(off) - 1
    start, _, row = word_spans(buf, off, ~SPACE)
    first = np.searchsorted(row, np.arange(n))
    begins = (np.arange(len(start)) - first[row]) % PASSAGE_WORDS == 0
    later = start[begins & (np.arange(len(start)) != first[row])]
    edges = np.sort(np.concatenate([off[:-1], later]))
    of = np.searchsorted(off[:-1], edges, "right") - 1
    # empty rows share an offset: give each its own edge
    same = np.flatnonzero(np.diff(off) == 0)
    if len(same):
        starts = np.concatenate([off[:-1], later])
        rows = np.concatenate([np.arange(n), np.searchsorted(off, later, "right") - 1])
        order = np.lexsort((rows, starts))
        edges, of = starts[order], rows[order]
    lengths = np.diff(np.append(edges, len(buf)))
    total = RAW + KINDS
    if len(buf) < 3:
        return np.zeros((len(edges), total), np.float32), of
    passage = np.repeat(np.arange(len(edges)), lengths)[:-2]
    x = np.zeros(len(edges) * total, np.float64)
    x += np.bincount(passage * total + _hashed(buf, 1, RAW), minlength=len(x))
    x += np.bincount(passage * total + RAW + _hashed(_KIND[buf], 2, KINDS), minlength=len(x))
    x = x.reshape(-1, total).astype(np.float32)
    return np.sqrt(x / np.maximum(1, lengths)[:, None]), of


@dataclass
class Model:
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]

    def forward(self, x: np.ndarray, first: np.ndarray):
        """first: each document's first passage."""
        n = np.diff(np.append(first, len(x)))
        h = np.tanh(x @ self.w + self.b)
        tv, su = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (tv * su) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        weight = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return score, (n, h, tv, su, weight, z)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        score, (n, h, tv, su, weight, z) = self.forward(x, first)
        g = (score - y) / len(y)
        dz = g[:, None] * self.c
        dzr = np.repeat(dz, n, axis=0)
        dweight = (dzr * h).sum(1)
        de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, first), n))
        dgate = de[:, None] * self.a
        dtv, dsu = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
        dh = (weight[:, None] * dzr + dtv @ self.v.T + dsu @ self.u.T) * (1 - h**2)
        return [x.T @ dh, dh.sum(0), h.T @ dtv, h.T @ dsu, ((tv * su) * de[:, None]).sum(0), z.T @ g, np.array(g.sum())]


class Trainer:
    """Adam on the logistic loss, a batch of whole documents at a time."""

    def __init__(self, width: int, epochs: int = EPOCHS, seed: int = 1):
        rng = np.random.default_rng(seed)
        s = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.model = Model(s(width, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), s(HIDDEN, GATE), s(HIDDEN, GATE), s(GATE), s(HIDDEN), np.array(0.0, np.float32))
        self.m, self.v = ([np.zeros_like(p) for p in self.model.parts()] for _ in range(2))
        self.step, self.epochs = 0, epochs

    def learn(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, epoch: int) -> None:
        grads = self.model.gradients(x, np.searchsorted(row, np.arange(len(y))), y)
        self.step += 1
        rate = 0.01 * (1 - epoch / self.epochs) + 0.0005
        for p, g, mm, vv in zip(self.model.parts(), grads, self.m, self.v, strict=True):
            g = g + 1e-5 * p
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            p -= (rate * (mm / (1 - 0.9**self.step)) / (np.sqrt(vv / (1 - 0.999**self.step)) + 1e-8)).astype(p.dtype)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(epoch, texts, labels) of BATCH documents of one epoch at most, fewer where they have more than BATCH_BYTES of text and are more than one."""
    texts, y, size, now = [], [], 0, None
    for batch in batches:
        for epoch, text, label in zip(batch.column("epoch").to_pylist(), batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            text = (text or "").encode()
            if texts and (epoch != now or len(texts) >= BATCH or size + len(text) > BATCH_BYTES):
                yield now, texts, y
                texts, y, size = [], [], 0
            now, size = epoch, size + len(text)
            texts.append(text)
            y.append(label)
    if texts:
        yield now, texts, y


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled documents; None if there is no label of each kind.

    Null labels and ids are skipped; of several labels of one document the least counts; documents that repeat an id count each, equal rows once. The sample
    is the first in the order of a hash of the id, and its whole texts are learned from. One task reads them as a stream, sorted anew for each epoch, and holds one batch
    of documents at a time; the driver gets the model alone.
    """
    short_batches(docs.sparkSession)
    own = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("name"))
    picked = rows.select("doc_id", "name").join(F.broadcast(own), "doc_id").dropDuplicates(["doc_id", "name"])  # at most `sample` rows of two numbers
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "name").limit(sample)
    chosen = rows.join(F.broadcast(picked), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"]).select("doc_id", "name", "text", "y")
    epochs = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, kinds = Trainer(RAW + KINDS), set()
        for epoch, texts, y in portions(batches):
            x, row = passages(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            kinds |= {v > 0 for v in y}
            trainer.learn(x, row, np.array([float(v > 0) for v in y], np.float32), epoch)
        if len(kinds) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trainer.model)], pa.binary())], names=["model"])

    order = ["epoch", F.xxhash64("epoch", "doc_id", "name"), "doc_id", "name"]
    found = epochs.repartition(1).sortWithinPartitions(*order).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of docs, `score` (0 to 1) and `n_passages`.

    Null texts count as empty; an empty text is one passage of zeros and is scored as such; without a model every score is 0.5; other columns pass
    unchanged (those named score or n_passages are replaced).
    """
    short_batches(docs.sparkSession)
    own = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("score", "n_passages")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 1 << 20):
            x, of = passages(*utf8(batch.column(text_col)))
            first = np.searchsorted(of, np.arange(len(batch)))
            s = np.full(len(batch), 0.5) if shared.value is None else shared.value.forward(x, first)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(float)), pa.array(np.bincount(of, minlength=len(batch)).astype(np.int64))], names=[*batch.schema.names, "score", "n_passages"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add("score", "double").add("n_passages", "long"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels of documents whose crc32(doc_id) mod 5 is not 0."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
