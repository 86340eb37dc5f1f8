"""Vector helpers over UTF-8 bytes: whole Arrow batches are hashed and cut into words without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.functions.shared import drop_folder, passing_tables, shared_folder
from strikeline.functions.shared import stored as shared_table

__all__ = ["drop_folder", "passing_tables", "shared_folder", "shared_table"]

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit value for each byte, so that short polynomials do not collide.
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Bytes of text that a task hashes at a time; temporary arrays are some ten times as large, and the tables of powers sixteen times.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_libc = ctypes.CDLL(None)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x.astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        m = max(n + 1, CHUNK_BYTES + 1, min(2 * len(_powers[0]), 1 << 22))
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(m, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with which span_hash gives the hash of any span of values in constant time."""
    s = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], dtype=U, out=s[1:])
    return s


def prefix_hash(data: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """prefix_sums of bytes."""
    return prefix_sums(byte[data])


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal byte strings have equal hashes, wherever they stand."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most, or one row."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Returns freed memory to the system: a Python worker lives on, and what its last stage took would be added to what the next one takes."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; no word crosses a row."""
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = is_word[data]
    before, after = m[:-2].copy(), m[2:].copy()
    cut = off[(off > 0) & (off < len(data))]
    before[cut] = False
    after[cut - 1] = False
    inside = m[1:-1]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k consecutive words of a row; a row of fewer words, but not none, is one shingle."""
    first = np.searchsorted(row, np.arange(n_rows))
    count = np.bincount(row, minlength=n_rows)
    h = np.zeros(len(words), U)
    c = U(0xD6E8FEB86659FD93)
    for j in range(k):
        short = words[j:]
        h[: len(short)] = h[: len(short)] * c + short
    whole = np.arange(len(words)) + k <= (first + count)[row] if len(words) else np.zeros(0, bool)
    out, rows = mix(h[whole]), row[whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        own = np.zeros(len(few), U)
        for j in range(k):
            more = count[few] > j
            own[more] = own[more] * c + words[first[few[more]] + j]
        out, rows = np.concatenate([out, mix(own + U(1))]), np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a partition that is sorted by key; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cut.tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and (a > 0 or held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def per_group(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, n: int | None = None) -> DataFrame:
    """fn over each group of a key; one sort, no Python call per row."""
    dealt = df.repartition(n, key) if n else df.repartition(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key):
            if (out := fn(table)) is not None:
                yield out

    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def row_name(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its id and text; a null id is none of the numbers, a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), key.isNull(), key, text), F.xxhash64(F.lit(2), key.isNull(), key, text)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows at most: a worker holds some MB even where texts are very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
