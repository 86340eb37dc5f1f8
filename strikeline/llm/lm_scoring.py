"""Language-model scoring by cross-entropy difference.

A background model of all documents and a target model of the target documents, both bigram models over the background's words, give
every token two losses; a document's score is the mean difference (below 0: more like the target).

    p_b(w) = c_b(w) / N_b                                  p_t(w) = (c_t(w) + NU p_b(w)) / (N_t + NU)
    p_m(w | v) = (c_m(v w) + MU p_m(w)) / (c_m(v) + MU)     v is the previous word, or the start of the document

Neither counts nor model pass through the driver. Documents are dealt to chunks; a chunk sends its distinct words and bigrams, hashed, with their
counts to buckets; a bucket adds up what all chunks sent and answers each chunk's keys; the chunk then scores its documents.

There are as many buckets as chunks. Where that is more than FAN, sums are made in rounds: a round settles one digit of the bucket among the chunks that
agree in all other digits, and answers go back the same way. A chunk so sends at most FAN messages a round, and messages grow with the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.vectors import LOWER, U, mix, prefix_hash, span_hash, utf8, word_spans

MU, NU = 20.0, 1000.0
CHUNK_TEXT = 6 << 20
FAN = 8192
TOTAL, START = U(1), U(2)


def _chunk_keys(texts: pa.Array, target: np.ndarray):
    """Distinct keys of a chunk, ascending, with background and target counts; for each token its row and the places of its
    word, of the word before it and of the bigram among the keys."""
    buf, off = utf8(texts)
    low = LOWER[buf]
    start, end, row = word_spans(low, off)
    h = span_hash(prefix_hash(low), start, end)
    first = np.append(True, row[1:] != row[:-1])[: len(h)]
    before = np.where(first, START, np.concatenate([[START], h[:-1]])) if len(h) else h
    pair = mix(before * U(0xD6E8FEB86659FD93) + h)
    keys, inverse = np.unique(np.concatenate([h, np.full(int(first.sum()), START), pair]), return_inverse=True)
    of = np.concatenate([row, row[first], row])
    bg = np.bincount(inverse, minlength=len(keys))
    tg = np.bincount(inverse, weights=target[of].astype(float), minlength=len(keys)).astype(np.int64)
    keys = np.concatenate([keys, [TOTAL]])
    bg, tg = np.append(bg, len(h)), np.append(tg, int(target[row].sum()))
    place = inverse[: len(h)]
    previous = np.where(first, np.searchsorted(keys[:-1], START), np.concatenate([[0], place[:-1]])) if len(h) else place
    return keys, bg, tg, row, place, previous, inverse[len(h) + int(first.sum()) :]


def _split(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a chunk in a fixed order, and whether each is a target."""
    docs = table.filter(pc.equal(table.column("kind"), 0)).sort_by([("row", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    marks = table.filter(pc.equal(table.column("kind"), 1)).column("row")
    return docs, np.asarray(pc.is_in(docs.column("row"), value_set=marks.combine_chunks()).combine_chunks().to_numpy(zero_copy_only=False), bool)


class _Net:
    """Addresses of chunks and buckets as numbers of `rounds` digits of base `fan`. Keys are 64 bits, of which the first say the bucket."""

    def __init__(self, n: int) -> None:
        self.rounds = 1
        while FAN**self.rounds < n:
            self.rounds += 1
        self.fan = 1
        while self.fan**self.rounds < n:
            self.fan += 1

    def digit(self, address: int, r: int) -> int:
        return address // self.fan**r % self.fan

    def moved(self, address: int, r: int, digit: int) -> int:
        return address + (digit - self.digit(address, r)) * self.fan**r

    def by_digit(self, keys: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the keys by digit r of their bucket, the digits, and where each begins."""
        bucket = ((keys >> U(32)) * U(self.fan**self.rounds)) >> U(32)
        digit = (bucket // U(self.fan**r) % U(self.fan)).astype(np.int64)
        order = np.argsort(digit, kind="stable")
        found, begin = np.unique(digit[order], return_index=True)
        return order, found, begin

    def messages(self, address: int, r: int, keys: np.ndarray, bg: np.ndarray, tg: np.ndarray) -> pa.Table:
        """What an address sends in a round: to, the digit it comes from, keys and counts."""
        order, found, begin = self.by_digit(keys, r)
        ends = np.append(begin[1:], len(order))
        cut = lambda x, pack: pa.array([pack(x[order[a:b]]) for a, b in zip(begin, ends, strict=True)], pa.binary())
        to = pa.array([self.moved(address, r, int(d)) for d in found], pa.int64())
        ks = cut(keys, lambda x: _pack_keys(x, self.width(r)))
        return pa.table({"to": to, "origin": pa.array([self.digit(address, r)] * len(found), pa.int32()), "ks": ks, "bg": cut(bg, _pack_counts), "tg": cut(tg, _pack_counts)})

    def width(self, r: int) -> int:
        """Bytes of a key in a round. In the last one the bucket is known, and with it the first byte where there are 256 buckets or more."""
        return 7 if r == self.rounds - 1 else 8

    def merged(self, table: pa.Table, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of an address's messages of a round, the place of every message's keys among them, and their sums."""
        keys, at = np.unique(np.concatenate([_unpack_keys(x.as_py(), self.width(r)) for x in table.column("ks")]), return_inverse=True)
        bg, tg = (np.bincount(at, weights=np.concatenate([_unpack_counts(x.as_py()) for x in table.column(c)]), minlength=len(keys)).astype(np.int64) for c in ("bg", "tg"))
        return keys, at, bg, tg

    def answered(self, keys: np.ndarray, r: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys that an address sent in a round, from the answers to it."""
        order, found, _ = self.by_digit(keys, r)
        at = {d: (x, y) for d, x, y in zip(*(answers.column(c).to_pylist() for c in ("digit", "bg", "tg")), strict=True)}
        out = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for k, x in enumerate(out):
            x[order] = np.concatenate([_unpack_counts(at[d][k]) for d in found.tolist()])
        return out

    def replies(self, table: pa.Table, r: int, at: np.ndarray, bg: np.ndarray, tg: np.ndarray) -> pa.Table:
        """Answers to the messages of a round: each gets the counts of its keys, in its order. at: the place of each message's keys among those counted."""
        ends = np.cumsum([len(x.as_py()) // self.width(r) for x in table.column("ks")])[:-1]
        address = table.column("to")[0].as_py()
        cut = lambda x: pa.array([_pack_counts(y) for y in np.split(x[at], ends)], pa.binary())
        to = pa.array([self.moved(address, r, o) for o in table.column("origin").to_pylist()], pa.int64())
        return pa.table({"to": to, "digit": pa.array([self.digit(address, r)] * len(table), pa.int32()), "bg": cut(bg), "tg": cut(tg)})


def _totals(sent: DataFrame, net: _Net, r: int = 0) -> DataFrame:
    """(to, digit, bg, tg): the answers to all messages of round r."""
    answer = "to long, digit int, bg binary, tg binary"
    if r == net.rounds - 1:

        def add(table: pa.Table) -> pa.Table:
            _, at, bg, tg = net.merged(table, r)
            return net.replies(table, r, at, bg, tg)

        return sent.groupBy("to").applyInArrow(add, answer)

    def onward(table: pa.Table) -> pa.Table:
        keys, _, bg, tg = net.merged(table, r)
        return net.messages(table.column("to")[0].as_py(), r + 1, keys, bg, tg)

    def back(own: pa.Table, answers: pa.Table) -> pa.Table:
        keys, at, *_ = net.merged(own, r)
        return net.replies(own, r, at, *net.answered(keys, r + 1, answers))

    answers = _totals(sent.groupBy("to").applyInArrow(onward, MESSAGE), net, r + 1)
    return sent.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(back, answer)


MESSAGE = "to long, origin int, ks binary, bg binary, tg binary"


def _pack_keys(keys: np.ndarray, width: int) -> bytes:
    """The last bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_keys(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; from 255 on it is among the 64-bit numbers at the end."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes() + int(large.sum()).to_bytes(8, "little")


def _unpack_counts(data: bytes) -> np.ndarray:
    n_large = int.from_bytes(data[-8:], "little")
    n = len(data) - 8 - 8 * n_large
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    if n_large:
        out[out == 255] = np.frombuffer(data, "<i8", n_large, n)
    return out


def domain_scores(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents against the model of the documents whose id is in `targets`.

    Returns per row of docs: doc_id, n_tokens, loss_target, loss_background and score, in nats per token. Words are runs of digits, letters and
    non-ASCII characters, lower-case in A-Z. A document without words (null and empty texts too) has null losses and score; a null id is never a
    target; repeated rows count and are answered each; without target documents both models agree but for their prior; other columns are ignored.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    own = docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(key, text).alias("row"))
    size = own.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    n = int(size // CHUNK_TEXT) + 1
    net = _Net(n)
    wanted = targets.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    none = F.lit(None)
    marks = own.select("doc_id", "row").join(wanted, "doc_id", "left_semi").select(none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "row").distinct()
    chunked = own.withColumn("kind", F.lit(0)).unionByName(marks.withColumn("kind", F.lit(1))).withColumn("chunk", F.pmod("row", F.lit(n)))

    def count(table: pa.Table) -> pa.Table:
        rows, target = _split(table)
        keys, bg, tg, *_ = _chunk_keys(rows.column("text"), target)
        return net.messages(table.column("chunk")[0].as_py(), 0, mix(keys), bg, tg)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, target = _split(left)
        keys, _, _, row, word, previous, pair = _chunk_keys(rows.column("text"), target)
        b, t = (x.astype(float) for x in net.answered(mix(keys), 0, right))
        n_b, n_t = b[-1], t[-1]
        p_b = b[word] / max(n_b, 1)
        p_t = (t[word] + NU * p_b) / (n_t + NU)
        loss_b = -np.log((b[pair] + MU * p_b) / (b[previous] + MU))
        loss_t = -np.log((t[pair] + MU * p_t) / (t[previous] + MU))
        n = np.bincount(row, minlength=len(rows))
        mean = lambda x: np.bincount(row, weights=x, minlength=len(rows)) / np.maximum(n, 1)
        none = n == 0
        lt, lb = mean(loss_t), mean(loss_b)
        return pa.table(
            {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)), "loss_target": pa.array(lt, mask=none), "loss_background": pa.array(lb, mask=none), "score": pa.array(lt - lb, mask=none)}
        )

    answers = _totals(chunked.groupBy("chunk").applyInArrow(count, MESSAGE), net)
    return chunked.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents against those labelled as of quality 1."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    found = domain_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target
  FROM documents
), tokens AS (
  SELECT doc_id, target, unnest(ws) AS w, unnest(list_concat([NULL], ws[1:len(ws) - 1])) AS v FROM words
), totals AS (
  SELECT count(*) AS n_b, count(*) FILTER (target) AS n_t FROM tokens
), unigrams AS (
  SELECT w, count(*) AS c_b, count(*) FILTER (target) AS c_t FROM tokens GROUP BY w
), contexts AS (
  SELECT w AS v, c_b, c_t FROM unigrams
  UNION ALL SELECT NULL, count(*), count(*) FILTER (target) FROM words WHERE len(ws) > 0
), bigrams AS (
  SELECT v, w, count(*) AS c_b, count(*) FILTER (target) AS c_t FROM tokens GROUP BY v, w
), p AS (
  SELECT g.v, g.w, g.c_b, g.c_t, c.c_b AS v_b, c.c_t AS v_t, u.c_b / n_b AS p_b, (u.c_t + 1000e0 * u.c_b / n_b) / (n_t + 1000e0) AS p_t
  FROM bigrams g JOIN unigrams u ON g.w = u.w JOIN contexts c ON g.v IS NOT DISTINCT FROM c.v, totals
), losses AS (
  SELECT v, w, -ln((c_b + 20e0 * p_b) / (v_b + 20e0)) AS l_b, -ln((c_t + 20e0 * p_t) / (v_t + 20e0)) AS l_t FROM p
), per_doc AS (
  SELECT doc_id, count(*) AS n, avg(l_t) AS l_t, avg(l_b) AS l_b FROM tokens t JOIN losses l ON t.w = l.w AND t.v IS NOT DISTINCT FROM l.v GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(l_t, 6) AS loss_target, round(l_b, 6) AS loss_background, round(l_t - l_b, 6) AS score
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
