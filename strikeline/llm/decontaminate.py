"""Benchmark decontamination: an FM-index per training shard, searched backwards for the windows of benchmark items.

A shard is a chunk of documents (4 MB of text). Its words are mapped to the ids of the benchmark's words; any other word is a
separator, and a run of known words that is shorter than the shortest window is left out, since no window can lie in it. Over the
rest a suffix array, its Burrows-Wheeler transform, a wavelet matrix for ranks and suffix positions sampled at every 8th text position are
built. All windows are searched at once, their occurrences are located by walking to a sampled position, and overlapping hits of a
document merge into removal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import LOWER, U, WORD, chunks, prefix_hash, ragged, row_name, shared_table, short_batches, span_hash, utf8, word_spans

SAMPLED = 8
SHARD_BYTES = 4 << 20
#: Benchmark text that one pass indexes and broadcasts; a larger benchmark takes several passes over blocks of items.
BLOCK_BYTES = 16 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of a text whose last symbol is its only 0. Doubling re-sorts only suffixes that are still tied."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    per = max(1, 62 // bits)
    padded = np.concatenate([t.astype(np.int64), np.zeros(per, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(per):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = per
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return sa
        own = sa[tied]
        ahead = np.where(own + depth < n, rank[np.minimum(own + depth, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sa[tied] = own[order]
        key = key[order]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        rank[sa[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        depth *= 2


class FMIndex:
    """Backward search and location over one text of small integers, 1 or more."""

    def __init__(self, text: np.ndarray):
        t = np.concatenate([text, [0]]).astype(np.int64)
        n = len(t)
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t))])
        self.bits = max(1, int(t.max()).bit_length())
        self.zeros: list[np.ndarray] = []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            z = np.zeros(n + 1, np.int64)
            np.cumsum(1 - one, out=z[1:])
            self.zeros.append(z)
            level = np.concatenate([level[one == 0], level[one == 1]])
        self.base = self._down(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, np.int64))
        self.sampled = sa % SAMPLED == 0
        self.at = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]

    def _down(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k, z in enumerate(self.zeros):
            low = z[pos]
            pos = np.where((symbol >> (self.bits - 1 - k)) & 1, z[-1] + pos - low, low)
        return pos

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        return self._down(symbol, pos) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, a row of a matrix; a pattern with an unknown symbol has none."""
        known = len(self.first) - 1
        ok = (patterns < known).all(1)
        low, high = np.zeros(len(patterns), np.int64), np.where(ok, len(self.bwt), 0)
        live = np.flatnonzero(ok)
        for j in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, j]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.rank(c, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.positions[self.at[rows]] + steps


class Windows:
    """The windows of a block of benchmark items, as patterns of word ids."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        data = [t.encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        buf = LOWER[np.frombuffer(b"".join(data), np.uint8)]
        start, end, row = word_spans(buf, off)
        h = span_hash(prefix_hash(buf), start, end)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 2  # 1 separates runs of known words
        self.names = [i for i, _ in items]
        found: dict[bytes, set[int]] = {}
        for i in range(len(items)):
            own = ids[row == i] if len(items) < 50 else ids[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
            for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                found.setdefault(own[k : k + size].astype(np.int64).tobytes(), set()).add(i)
        by: dict[int, list[bytes]] = {}
        for p in found:
            by.setdefault(len(p) // 8, []).append(p)
        self.patterns = [np.frombuffer(b"".join(ps), np.int64).reshape(-1, n) for n, ps in sorted(by.items())]
        self.items = [[sorted(found[p]) for p in by[n]] for n in sorted(by)]
        self.shortest = min(by, default=0)


def _search(windows: Windows, buf: np.ndarray, off: np.ndarray):
    """Words of each row, a mask of hit words, and (row, item) pairs."""
    low = LOWER[buf]
    start, end, row = word_spans(low, off)
    hit, pairs = np.zeros(len(start) + 1, np.int64), []
    if len(start) and len(windows.vocabulary):
        h = span_hash(prefix_hash(low), start, end)
        at = np.minimum(np.searchsorted(windows.vocabulary, h), len(windows.vocabulary) - 1)
        known = windows.vocabulary[at] == h
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = b - a >= windows.shortest
        a, n = a[long], (b - a)[long]
        if len(a):
            place = np.cumsum(n + 1) - (n + 1)
            words = ragged(a, n)
            text, back = np.ones(int((n + 1).sum()), np.int64), np.full(int((n + 1).sum()), -1)
            slots = ragged(place, n)
            text[slots], back[slots] = at[words] + 2, words
            index = FMIndex(text)
            for patterns, items in zip(windows.patterns, windows.items, strict=True):
                lo, hi = index.search(patterns)
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                counts = (hi - lo)[some]
                first = back[index.locate(ragged(lo[some], counts))]
                np.add.at(hit, first, 1)
                np.add.at(hit, first + patterns.shape[1], -1)
                for p, rows in zip(some, np.split(row[first], np.cumsum(counts)[:-1]), strict=True):
                    pairs += [(r, i) for r in np.unique(rows).tolist() for i in items[p]]
    return start, end, row, np.cumsum(hit)[:-1] > 0, pairs


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about BLOCK_BYTES, or one item, each collected only when it is asked for. Where there are several, the items are first written by
    block, so that a block reads its own alone."""
    own = benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    dealt = own.where(F.col("i").isNotNull()).withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    if n > 1:
        dealt = shared_table(dealt.repartitionByRange(n, "block").sortWithinPartitions("block"))
    for k in range(n):
        yield [(r.i, r.t) for r in dealt.where(F.col("block") == k).collect()]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Hits of benchmark windows in documents.

    Returns all columns of docs and n_words, n_hit, items (array<string>, sorted), spans (array<struct<first,last>>: merged hit runs, in bytes of
    the text). A window is `window` consecutive words of an item; an item of fewer words is one window. Null or empty texts have no words,
    an empty benchmark or one of null texts hits nothing, items of null id are skipped, repeated rows are each answered, other columns of docs pass
    unchanged (those of the four names are replaced).
    """
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ADDED])
    earlier, held = [], None
    for block in _blocks(benchmark, item_col, "text"):
        if held is not None:
            earlier.append(_hits_of_texts(rows, text_col, Windows(held, window)))
        held = block
    windows = spark.sparkContext.broadcast(Windows(held or [], window))
    merged = bool(earlier)
    if merged:  # hits depend on the text alone
        one, two = row_name(F.lit(0), F.col(f"`{text_col}`"))
        hits = reduce(DataFrame.unionByName, earlier).groupBy("_t1", "_t2").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))  # one row for each block
        rows = rows.withColumns({"_t1": one, "_t2": two}).join(hits, ["_t1", "_t2"], "left").drop("_t1", "_t2")
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ADDED]).add("n_words", "long").add("n_hit", "long")
    schema = schema.add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, SHARD_BYTES):
            kept = [(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True) if c not in ADDED]
            yield pa.RecordBatch.from_arrays([*(x for _, x in kept), *_hits(batch, text_col, windows.value, merged)], names=[*(c for c, _ in kept), *ADDED])

    return rows.mapInArrow(run, schema)


ADDED = ("n_words", "n_hit", "items", "spans")


def _hits(batch: pa.RecordBatch, text_col: str, windows: Windows, merged: bool = False) -> list[pa.Array]:
    """ADDED of each row; merged: the batch has items and spans of other blocks."""
    buf, off = utf8(batch.column(text_col))
    start, end, row, hit, pairs = _search(windows, buf, off)
    n = len(batch)
    items: list[set[str]] = [set(x or ()) for x in batch.column("items").to_pylist()] if merged else [set() for _ in range(n)]
    for r, i in pairs:
        items[r].add(windows.names[i])
    for r, found in enumerate(batch.column("spans").to_pylist() if merged else ()):
        for x in found or ():
            hit[np.searchsorted(start, off[r] + x["first"]) : np.searchsorted(start, off[r] + x["last"])] = True
    begins, ends = hit.copy(), hit.copy()
    if len(hit):
        begins[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        ends[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True):
        spans[row[a]].append({"first": int(start[a] - off[row[a]]), "last": int(end[b] - off[row[a]])})
    return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(np.bincount(row[hit], minlength=n).astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, SPANS)]


def _hits_of_texts(rows: DataFrame, text_col: str, block: Windows) -> DataFrame:
    """_t1, _t2 (128 bits of a text), items and spans of each text that one block hits, as a stored table."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            _, n_hit, items, spans = _hits(batch, "text", shared.value)
            some = pc.greater(n_hit, 0)
            yield pa.RecordBatch.from_arrays([x.filter(some) for x in (batch.column("_t1"), batch.column("_t2"), items, spans)], names=["_t1", "_t2", "items", "spans"])

    text = F.col(f"`{text_col}`")
    one, two = row_name(F.lit(0), text)
    found = rows.select(text.alias("text"), one.alias("_t1"), two.alias("_t2")).mapInArrow(run, "_t1 long, _t2 long, items array<string>, spans array<struct<first: long, last: long>>")
    out = shared_table(found.groupBy("_t1", "_t2").agg(F.first("items").alias("items"), F.first("spans").alias("spans")))
    shared.unpersist()
    return out


def digest(hits: DataFrame) -> DataFrame:
    """Counts and item digests of each document."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text with a space in place of every span; spans are byte ranges at word edges."""
    raw = F.encode(text, "UTF-8")
    state = F.aggregate(
        spans,
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct(
            (x["last"] + 1).alias("at"),
            F.concat(s["kept"], F.array(F.decode(F.substring(raw, s["at"].cast("int"), (x["first"] + 1 - s["at"]).cast("int")), "UTF-8"))).alias("kept"),
        ),
        lambda s: F.concat(s["kept"], F.array(F.decode(F.substring(raw, s["at"].cast("int"), F.lit(2147483647)), "UTF-8"))),
    )
    return F.when(F.size(spans) > 0, F.array_join(state, " ")).otherwise(text)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document of the table against every benchmark item."""
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], size: int = 10) -> dict[int, tuple]:
    """Direct comparison of all windows, for tests."""
    cut = lambda t: WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, {}
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[p]
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
