"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full text and counted, each distinct one is encoded by both tokenizers, and byte offsets where tokens of both end cut it
into groups. At such an offset the two tokens that end there are linked. One of them is then a suffix of the other, so the vocabularies bound the id
pairs that can be linked (some 200,000 for the public ones): link counts are vectors of that length, weighted by how often a text stands in the corpus,
summed by Spark and sent back whole. Measures of distinct texts are joined to the documents by the SHA-256 of the text.

A is a byte-level BPE whose merges make its ids in order (then its ranks are its ids, and the ranks are applied directly) or any other file of the same
library; B is a SentencePiece model. B's pieces hold their space mark in front only, so units between spaces are encoded apart, and short ones are kept;
a text whose units do not join to its bytes is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.vectors import chunks, shared_table, short_batches, utf8

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Units of B of at most this many characters are remembered, and so many of them.
SHORT_UNIT, KEPT_UNITS = 32, 1 << 17
UNIT = re.compile(" +[^ ]*")
SPACE_MARK = "▁"


def default_files() -> tuple[str, str]:
    """The places of the public vocabularies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _encoder_a(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """The encoding function and the bytes of every id; entries that are not letters of bytes have none."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    vocabulary = [b""] * (1 + max(model["vocab"].values()))
    for token, i in model["vocab"].items():
        if all(c in letters for c in token):
            vocabulary[i] = bytes(letters[c] for c in token)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merged)) and len(vocabulary) == 256 + len(merged) and all(vocabulary):
        import public_tokenizers
        import tiktoken

        ranks = {b: i for i, b in enumerate(vocabulary)}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, vocabulary
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return lambda text: plain.encode(text, add_special_tokens=False).ids, vocabulary


def _encoder_b(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]], list[bytes]]:
    """Encoding by units, encoding of the whole text, and the bytes of every id; neither gets the space that the model adds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary, inner = [], False
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            vocabulary.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            vocabulary.append(b"")
        else:
            vocabulary.append(piece.replace(SPACE_MARK, " ").encode())
            inner |= SPACE_MARK in piece.lstrip(SPACE_MARK)
    kept: dict[str, list[int]] = {}

    def unit(u: str) -> list[int]:
        ids = kept.get(u)
        if ids is None:
            ids = model.encode(u[1:])
            if len(u) <= SHORT_UNIT:
                if len(kept) >= KEPT_UNITS:
                    kept.clear()
                kept[u] = ids
        return ids

    def by_units(text: str) -> list[int]:
        return list(chain.from_iterable(map(unit, UNIT.findall(" " + text))))

    return (model.encode if inner else by_units), model.encode, vocabulary


@dataclass
class Pair:
    """Both tokenizers. `keys` are all a * len(bytes_b) + b that can be linked, ascending."""

    encode_a: Callable[[str], list[int]]
    encode_b: Callable[[str], list[int]]
    encode_b_whole: Callable[[str], list[int]]
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self) -> None:
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        by_a, by_b = _by_bytes(self.bytes_a), _by_bytes(self.bytes_b)
        links = {(a, b) for x, own in by_a.items() for k in range(len(x)) for b in by_b.get(x[k:], ()) for a in own}
        links |= {(a, b) for x, own in by_b.items() for k in range(len(x)) for a in by_a.get(x[k:], ()) for b in own}
        self.keys = np.sort(np.array([a * len(self.bytes_b) + b for a, b in links], np.int64))
        # every id with what may follow it in the text of groups
        self.written = pa.array([f"{i}{c}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in (",", "|", ";", "")], pa.large_string())


def _by_bytes(vocabulary: list[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for i, x in enumerate(vocabulary):
        if x:
            found.setdefault(x, []).append(i)
    return found


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    a, bytes_a = _encoder_a(path_a)
    b, whole, bytes_b = _encoder_b(path_b)
    return Pair(a, b, whole, bytes_a, bytes_b)


def encode(texts: list[str], pair: Pair) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of A and B of each text; none of either where the joined bytes are not those of a space and the text."""
    all_a, all_b = [], []
    for text in texts:
        want = (" " + text).encode()
        a, b = pair.encode_a(" " + text), pair.encode_b(text)
        if b"".join([pair.bytes_b[i] for i in b]) != want:
            b = pair.encode_b_whole(text)
            if b"".join([pair.bytes_b[i] for i in b]) != want:
                a = b = []
        if b"".join([pair.bytes_a[i] for i in a]) != want:
            a = b = []
        all_a.append(a)
        all_b.append(b)
    return all_a, all_b


def align(all_a: list[list[int]], all_b: list[list[int]], pair: Pair) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The places in pair.keys of all links of all texts in order, the number of each text's links (which is that of its groups), and the digests of groups."""
    a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (all_a, all_b))
    first_a, first_b = (np.cumsum([0, *map(len, x)]) for x in (all_a, all_b))
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    here = np.zeros((2, int(end_a[-1] if len(a) else 0) + 1), bool)
    here[0, end_a] = here[1, end_b] = True
    last_a, last_b = here[1, end_a], here[0, end_b]  # tokens that end a group
    links = np.searchsorted(pair.keys, a[last_a] * len(pair.bytes_b) + b[last_b])
    up_to_a, up_to_b = (np.flatnonzero(x) + 1 for x in (last_a, last_b))  # tokens up to the end of each group
    n_links = np.diff(np.searchsorted(up_to_a, first_a, "right"))

    after_a, after_b = np.where(last_a, 1, 0), np.where(last_b, 2, 0)
    after_b[first_b[1:][np.diff(first_b) > 0] - 1] = 3
    group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.concatenate([[0], up_to_b])[group_a]] = a * 4 + after_a
    order[np.arange(len(b)) + (up_to_a[group_b] if len(b) else 0)] = b * 4 + after_b
    data, off = utf8(pair.written.take(pa.array(order)))
    at = off[first_a + first_b]
    return links, n_links, [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]


def _aligned(batches: Iterator[pa.RecordBatch], files: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    pair = tokenizers(*files)
    for batch in chunks(batches):
        all_a, all_b = encode(batch.column("text").to_pylist(), pair)
        links, n_links, digests = align(all_a, all_b, pair)
        off = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("copies"), pa.array([len(x) for x in all_a], pa.int64()), pa.array([len(x) for x in all_b], pa.int64()),
                pa.array(n_links, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(off, pa.array(links, pa.int32())),
            ],
            ["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
        )


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def link_counts(aligned: DataFrame, n_keys: int) -> np.ndarray:
    """How many links of the corpus hold each pair that can be linked. A task gives a row for each pair it has, n_keys at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_keys, np.int64)
        for batch in batches:
            links, n = _flat(batch.column("links"))
            total += np.bincount(links, np.repeat(batch.column("copies").to_numpy(), n), n_keys).astype(np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["pair", "n"])

    found = aligned.select("copies", "links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_keys, np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    return counts


def alignment(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or that a tokenizer does not give back byte by byte have no tokens: zeros and an empty digest; so an empty table gives no
    rows. n_best: links whose count is the highest of their B id, ties included; count_sum: the sum of the counts over links. Repeated rows each count and
    each get a row; a null key stays null; other columns of docs are not read. A text is worked on whole, however long.
    """
    spark, files = docs.sparkSession, files or default_files()
    short_batches(spark)
    named = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))
    distinct = named.where("text != ''").groupBy("text").agg(F.count("*").alias("copies")).select(F.sha2("text", 256).alias("key"), "copies", "text")
    aligned = shared_table(distinct.mapInArrow(lambda it: _aligned(it, files), "key string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"))
    pair = tokenizers(*files)
    counts = link_counts(aligned, len(pair.keys))
    highest = np.zeros(len(pair.bytes_b), np.int64)
    of_b = pair.keys % len(pair.bytes_b)
    np.maximum.at(highest, of_b, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[of_b]))  # as long as the list of pairs that can be linked

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            links, n = _flat(batch.column("links"))
            off = np.concatenate([[0], np.cumsum(n)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)])[off]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n_a", "n_b", "n_groups", "groups_sha256")), *map(pa.array, sums)], ["key", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])

    found = aligned.select("key", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(measures, "key string, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    out = named.select("doc_id", F.sha2("text", 256).alias("key")).join(found.withColumn("n_links", F.col("n_groups")), "key", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment measures of every document."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
