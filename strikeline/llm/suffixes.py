"""Removal of long repeated strings, by sorting a sample of suffixes outside memory and inducing the result for all others.

A string is of bytes or of words (a rule says which, and how long). Sorting a tuple for every position, as induced sorting does, would write some 27 times
the input to disk here, so the sample is sparse. Like the left-most-smallest positions of induced sorting, a suffix is sampled by its content: of the
windows of `length` symbols, each marks the gram in it with the least hash. Windows that share their mark form a run, and equal windows have equal marks,
at an equal distance.

1.  Every run gives one tuple: the gram at its mark, the name (hash) of all symbols its windows cover, and its place. Tuples whose gram stands nowhere
    else are done; the others are written once.
2.  These are sorted and merged by Spark's external shuffle. A name that repeats makes all windows of its runs repeated.
3.  For names that do not repeat but share their gram, the windows are induced: the covered symbols are dealt by gram, and there the windows
    themselves are named and sorted. The windows of a gram of more than IN_MEMORY tuples are dealt by their own names too.

Names are compared within their gram only, so 128 bits decide that strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import BYTE, LOWER, U, chunks, groups, mix, powers, prefix_hash, prefix_sums, ragged, row_name, shared_table, short_batches, span_hash, utf8, word_spans

LENGTH = 400
#: Tuples of one gram that a task compares in memory.
IN_MEMORY = 4096
FLUSH_BYTES = 2 << 20
#: Bytes of text, and windows of a long text, that are named at a time: the processor's cache holds them.
CHUNK, SLICE = 1 << 18, 1 << 20
#: A place is a number: the first window start in the text, 16 bits of how many starts follow, a bit for large grams, one for names that do
#: not repeat, and 6 bits of the rule.
FIRST, MORE, LARGE, OPEN, RULE = 24, 8, 128, 64, 63


class Rule(NamedTuple):
    """Which strings count as repeated: `length` bytes, or words (digits, letters, non-ASCII characters; lower-case A-Z) whatever stands between them,
    that start anywhere else too, or with `across` in another document (rows of equal id and text are one document)."""

    unit: str = "byte"
    length: int = LENGTH
    across: bool = False

    @property
    def gram(self) -> int:
        return max(1, self.length // 6 if self.unit == "byte" else self.length // 4)


STRINGS = Rule()
PASSAGES = Rule("word", 50, True)


def _symbols(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A value for each symbol, each row's offsets among them, and where symbols start and end in the buffer."""
    if unit == "byte":
        at = np.arange(len(buf) + 1)
        return BYTE[buf], off, at[:-1], at[1:]
    low = LOWER[buf]
    start, end, row = word_spans(low, off)
    return span_hash(prefix_hash(low), start, end), np.searchsorted(row, np.arange(len(off))), start, end


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by the least of 1, 2, 4, ... of them."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def _runs(s: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Runs of windows with one mark: row, mark, first and last window start. s: prefix sums of the symbols of rows that begin at off."""
    k, length = rule.gram, rule.length
    n = len(s) - length
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    packed = s[k:] - s[:-k]
    packed *= powers(len(s))[1][: len(packed)]
    packed &= U(0xFFFFFFFFF0000000)
    packed |= np.arange(len(packed), dtype=U)
    mark = _least(packed, length - k + 1)
    new = np.ones(n, bool)
    np.not_equal(mark[1:], mark[:-1], out=new[1:])
    new[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(new)
    last = np.append(start[1:], n) - 1
    row = np.searchsorted(off, start, "right") - 1
    inside = start + length <= off[row + 1]
    start, last, row = start[inside], last[inside], row[inside]
    return row, (mark[start] & U(0xFFFFFFF)).astype(np.int64), start, np.minimum(last, off[row + 1] - length)


def _slices(values: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Symbols, offsets and the place of the first symbol; a row of many windows comes in parts that share no window. A run that is cut has
    another name than its copies, and its windows are compared one by one."""
    if len(off) == 2 and len(values) - length + 1 > SLICE:
        for p in range(0, len(values) - length + 1, SLICE):
            part = values[p : p + SLICE + length - 1]
            yield part, np.array([0, len(part)]), p
    else:
        yield values, off, 0


def _tuples(rules: tuple[Rule, ...]):
    """mapInArrow: (k1, k2, text) to (k1, k2, gram, name, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            buf, off = utf8(batch.column("text"))
            for r, rule in enumerate(rules):
                values, own, *_ = _symbols(buf, off, rule.unit)
                for part, at, skipped in _slices(values, own, rule.length):
                    s = prefix_sums(part)
                    row, mark, p1, p2 = _runs(s, at, rule)
                    if not len(row):
                        continue
                    gram = mix(span_hash(s, mark, mark + rule.gram) ^ U(r + 1))
                    place = ((p1 - at[row] + skipped) << FIRST) | ((p2 - p1) << MORE) | r
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(take), batch.column("k2").take(take), pa.array(gram.view(np.int64)), pa.array(span_hash(s, p1, p2 + rule.length).view(np.int64)), pa.array(place)],
                        names=["k1", "k2", "gram", "name", "place"],
                    )

    return run


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window start, last window start and rule of places."""
    first = x >> FIRST
    return first, first + ((x >> MORE) & 0xFFFF), x & RULE


def _covered(rules: tuple[Rule, ...]):
    """mapInArrow: texts with their runs of shared grams to (bucket, k1, place, k2, values, at). values has the run's symbols, or, for large
    grams, the names of those of its windows that belong to the bucket; at has their distances from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, runs in enumerate(batch.column("runs")):
                gram, place, deal = (np.array(x) for x in zip(*((r["gram"], r["place"], r["deal"]) for r in runs.as_py()), strict=True))
                k1, k2 = batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
                buf, off = utf8(batch.column("text").slice(i, 1))
                first, last, of = _places(place)
                for r in np.unique(of):
                    rule = rules[r]
                    values, *_ = _symbols(buf, off, rule.unit)
                    raw = buf if rule.unit == "byte" else values
                    mine = of == r
                    for g, x, a, b in zip(*(c[mine & (deal == 1)].tolist() for c in (gram, place, first, last)), strict=True):
                        out.append((g, k1, k2, x, raw[a : b + rule.length].tobytes(), b""))
                    large = mine & (deal > 1)
                    s = prefix_sums(values) if large.any() else None
                    for g, x, a, b, n in zip(*(c[large].tolist() for c in (gram, place, first, last, deal)), strict=True):
                        start = np.arange(a, b + 1)
                        h = span_hash(s, start, start + rule.length)
                        part = mix(h) % U(n)
                        order = np.argsort(part, kind="stable")
                        cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
                        for own in np.split(order, cut[1:]):
                            bucket = int((mix(part[own[:1]]) ^ np.array([g]).view(U)).view(np.int64)[0])
                            out.append((bucket, k1, k2, x | LARGE, h[own].tobytes(), own.astype(np.uint16).tobytes()))
                if sum(len(x[4]) for x in out) > FLUSH_BYTES:
                    yield _parts(out)
                    out = []
            if out:
                yield _parts(out)

    return run


PARTS = "bucket long, k1 long, k2 long, place long, values binary, at binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "k1", "k2", "place", "values", "at"])


def _windows(t: pa.Table, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, tuple and start of every window of the tuples of one rule."""
    place = t.column("place").to_numpy()
    large = (place & LARGE) > 0
    data = t.column("values").to_pylist()
    first = place >> FIRST
    names, of, start = [], [], []
    own = np.flatnonzero(~large)
    if len(own):
        raw = np.frombuffer(b"".join(data[i] for i in own), np.uint8 if rule.unit == "byte" else U)
        s = prefix_sums(BYTE[raw] if rule.unit == "byte" else raw)
        size = np.array([len(data[i]) for i in own]) // raw.itemsize
        n = size - rule.length + 1
        at = ragged(np.cumsum(size) - size, n)
        names.append(span_hash(s, at, at + rule.length))
        of.append(np.repeat(own, n))
        start.append(ragged(first[own], n))
    own = np.flatnonzero(large)
    if len(own):
        names.append(np.frombuffer(b"".join(data[i] for i in own), U))
        of.append(np.repeat(own, [len(data[i]) // 8 for i in own]))
        more = t.column("at").to_pylist()
        start.append(first[of[-1]] + np.frombuffer(b"".join(more[i] for i in own), np.uint16))
    return np.concatenate(names), np.concatenate(of), np.concatenate(start)


def _induce(rules: tuple[Rule, ...]):
    """mapInArrow over tuples sorted by bucket: (k1, k2, place) of the repeated windows of tuples whose name does not repeat."""

    def repeated(t: pa.Table, r: int) -> tuple[np.ndarray, np.ndarray]:
        place, k1, bucket = (t.column(c).to_numpy() for c in ("place", "k1", "bucket"))
        h, of, start = _windows(t, rules[r])
        order = np.lexsort((h, bucket[of]))
        b, x = bucket[of][order], h[order]
        cut = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (b[1:] != b[:-1])))
        size = np.diff(np.append(cut, len(x)))
        is_open = (place[of][order] & OPEN) > 0
        if rules[r].across:
            doc = k1[of][order]
            # a name that repeats stands in several documents, of which one is here
            hit = (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)) | ~np.logical_and.reduceat(is_open, cut)
        else:
            hit = size > 1
        got = order[np.repeat(hit, size) & is_open]
        own, at = of[got], start[got]
        by = np.lexsort((at, own))
        own, at = own[by], at[by]
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)])
        last = np.append(new[1:], len(at))[: len(new)] - 1
        return own[new], (at[new] << FIRST) | ((at[last] - at[new]) << MORE) | r

    def flush(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables).combine_chunks()
        of = t.column("place").to_numpy() & RULE
        for r in np.unique(of):
            mine = t.filter(pa.array(of == r)).combine_chunks()
            own, place = repeated(mine, int(r))
            if len(own):
                k1, k2 = (mine.column(c).combine_chunks().take(pa.array(own)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([k1, k2, pa.array(place)], names=["k1", "k2", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in groups(batches, "bucket"):
            held.append(table)
            size += table.nbytes
            if size > FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def with_repeats(own: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """own (row, k1, k2, text; a document is known by (k1, k2)) with `whole` and `induced`, arrays of places of its repeated windows, or null."""
    least = min(r.length if r.unit == "byte" else 2 * r.length - 1 for r in rules)
    tuples = own.where(F.octet_length("text") >= least).select("k1", "k2", "text").mapInArrow(_tuples(rules), "k1 long, k2 long, gram long, name long, place long")
    shared = tuples.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    found = shared_table(tuples.join(shared, "gram", "left_semi")).withColumn("row", F.xxhash64("k1", "k2", "place"))

    across = F.element_at(F.array(*(F.lit(r.across) for r in rules)), F.col("place").bitwiseAND(RULE).cast("int") + 1)
    names = found.groupBy("gram", "name").agg(F.count("*").alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("row").alias("one"), F.bool_or(across).alias("across"))
    several = F.col("lo") != F.col("hi")
    names = names.withColumn("repeats", F.when(F.col("across"), several).otherwise(F.col("n") > 1))
    # tuples that are compared: all of names that do not repeat, one of those that do
    per_gram = names.groupBy("gram").agg(
        F.count("*").alias("m"), F.bool_and("repeats").alias("closed"), F.sum(F.when(F.col("repeats"), 1).otherwise(F.col("n"))).alias("rows"),
        F.bool_or("across").alias("across"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    ).where((F.col("m") > 1) & ~F.col("closed") & (~F.col("across") | several)).select("gram", F.ceil(F.col("rows") / IN_MEMORY).alias("deal"))
    judged = found.join(names.select("gram", "name", "repeats", "one"), ["gram", "name"]).join(per_gram, "gram", "left")
    compared = F.col("deal").isNotNull() & (~F.col("repeats") | (F.col("row") == F.col("one")))
    place = F.col("place") + F.when(F.col("repeats"), 0).otherwise(OPEN)
    by_text = judged.where(F.col("repeats") | compared).groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("repeats"), F.col("place"))).alias("whole"), F.collect_list(F.when(compared, F.struct("gram", place.alias("place"), "deal"))).alias("runs")
    )
    by_text = shared_table(by_text)

    parts = own.join(by_text.where(F.size("runs") > 0).select("k1", "k2", "runs"), ["k1", "k2"]).mapInArrow(_covered(rules), PARTS)
    induced = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_induce(rules), "k1 long, k2 long, place long")
    induced = induced.groupBy("k1", "k2").agg(F.collect_set("place").alias("induced"))
    return own.join(by_text.select("k1", "k2", "whole"), ["k1", "k2"], "left").join(induced, ["k1", "k2"], "left")


def _spans(places: np.ndarray, r: int, rule: Rule, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in bytes, of the maximal parts that repeated windows of a rule cover."""
    first, last, of = _places(places)
    first, last = first[of == r], last[of == r]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + rule.length)
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    begin, end = first[new], end[np.append(new[1:], len(first)) - 1]
    if rule.unit == "byte":
        return begin, end
    start, stop, _ = word_spans(LOWER[buf], np.array([0, len(buf)]))
    return start[begin], stop[end - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None, report: Rule | None = None) -> DataFrame:
    """Removal of each byte that a repeated string covers: by default, a string of `length` bytes that also starts anywhere else in the table, the
    same document included; `rule` states another.

    Returns per row of docs: row (a struct of its other columns), text (null counts as empty), n_bytes, n_removed, n_spans, kept_text (without
    characters of which a part was removed) and kept_sha256 (of the kept bytes); with `report`, a rule by which nothing is removed, also n_passages and
    passage_bytes, the number and bytes of its repeated strings. Strings are judged on the input, so of equal texts of `length` bytes or more nothing is left in
    either. Shorter texts keep all; repeated rows and ids, null ids and ties are each answered; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    rules = (rule or Rule(length=length),) + ((report,) if report else ())
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    k1, k2 = row_name(key, text)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    joined = with_repeats(own, rules).select("row", "text", "whole", "induced")
    schema = T.StructType([own.schema["row"], own.schema["text"]])
    added = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_text", "string"), ("kept_sha256", "string")]
    if report:
        added += [("n_passages", "long"), ("passage_bytes", "long")]
    for column, kind in added:
        schema = schema.add(column, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if kind == "string" else pa.int64() for _, kind in added]
        for batch in batches:
            rows = []
            for t, whole, induced in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "induced")), strict=True):
                data = t.encode()
                if not whole and not induced:
                    rows.append((len(data), 0, 0, t, hashlib.sha256(data).hexdigest(), 0, 0)[: len(added)])
                    continue
                buf = np.frombuffer(data, np.uint8)
                places = np.array([*(whole or ()), *(induced or ())], np.int64)
                begin, end = _spans(places, 0, rules[0], buf)
                gone = np.zeros(len(data), bool)
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    gone[a:b] = True
                # a character is kept if all of its bytes are
                at = np.flatnonzero((buf & 0xC0) != 0x80)
                partly = np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(data))))
                made = (len(data), int(gone.sum()), len(begin), buf[~partly].tobytes().decode(), hashlib.sha256(buf[~gone].tobytes()).hexdigest())
                if report:
                    begin, end = _spans(places, 1, report, buf)
                    made += (len(begin), int((end - begin).sum()))
                rows.append(made)
            columns = list(zip(*rows, strict=True)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that repeat anywhere in all documents; beside them, passages of 50 words that repeat across documents."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), report=PASSAGES)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple]:
    """Direct count of all strings, for tests."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen: dict[bytes, int] = {}
    for d in data.values():
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out
