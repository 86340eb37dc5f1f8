"""N-gram Jaccard join by chosen paths.

Sets are the distinct runs of five words of a text; documents of equal sets are one member with a weight. In every run a set chooses about
PER_RUN of its elements by a hash that all sets share; sets that choose one element meet in its bucket. Every bucket of more than SMALL members is split
again by the next level's chosen elements, LEVELS levels at most; small buckets, and what is left after the last level, are compared. A large bucket
of which all but PART members are like one of them is not split: links to that one connect them, and the others are compared with all. All runs are made at once:
a level has the elements that any run chooses, and a path goes on with a part of them that a hash of the path picks, so that paths fail independently.
Runs, and the part by the size of the set, are such that a pair of the least similarity misses with a chance below 1 - RECALL where all of its buckets are large.

Within buckets, pairs are first compared by sketches of minimum hashes. The connected parts of what sketches link are groups; the sets of a
group are compared exactly, in blocks of BLOCK times BLOCK members. Only counts of links and a spanning tree leave a block, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.vectors import LOWER, U, chunks, groups, mix, prefix_hash, row_name, shared_table, shingles, short_batches, span_hash, utf8, word_spans

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
PER_RUN, LEVELS, SMALL = 2.0, 3, 128
#: Sets of at most this size choose all elements. The part that a path goes on with is found for each size up to SIZES; larger sets need no more.
WHOLE, SIZES = 8, 128
SKETCH, PART = 128, 1024
#: Members of one side of a block of pairs.
BLOCK = 512
#: A sketch of SKETCH bytes links a pair whose estimate is this far below the similarity: over four standard deviations.
SKETCH_SLACK = 0.16
#: Rows of a partition of a frame of links or labels; smaller frames have fewer partitions, and so fewer files.
LINKS = 200_000


def _chosen(size: np.ndarray, runs: int, per_run: float = PER_RUN) -> np.ndarray:
    """The chance that any of the runs chooses an element of a set."""
    return np.where(size <= WHOLE, 1.0, 1 - (1 - np.minimum(per_run / size, 1.0)) ** runs)


def missed(size: int, part: float, runs: int, similarity: float = SIMILARITY, per_run: float = PER_RUN) -> float:
    """The chance that two sets meet in no bucket of the last level, if all above are large. At least similarity * size elements of the larger one
    are shared (all of the smaller one, where it is a subset); a path does not repeat its elements."""
    shared = math.ceil(similarity * size - 1e-9)
    chosen = float(_chosen(np.array(size), runs, per_run))
    k = np.arange(min(shared, 10 * math.ceil(per_run * runs)) + 1)
    if chosen == 1:
        chance = (k == shared).astype(float)
    else:
        ways = np.append(0.0, np.cumsum(np.log((shared - k[:-1]) / (k[:-1] + 1))))
        chance = np.exp(ways + k * math.log(chosen) + (shared - k) * math.log1p(-chosen))
    dead, weight = np.zeros(1), np.ones(1)
    for level in range(LEVELS - 1, 0, -1):
        dead = ((1 - part * (1 - dead[:, None])) ** np.maximum(k - level, 0)).ravel()
        weight = (weight[:, None] * chance).ravel()
    return float((weight * (1 - chosen * (1 - dead)) ** shared).sum())


def _least_size(similarity: float) -> int:
    """Sets below this size can run out of elements; their paths also stay as they are."""
    return math.floor(LEVELS / similarity + 1e-9) + 1


@lru_cache
def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, per_run: float = PER_RUN) -> int:
    """Runs until the target recall, where a path goes on with 1.25 times the elements that one run chooses, or with more in small sets."""
    runs = 1
    while missed(10**6, min(1.25 / runs, 1.0), runs, similarity, per_run) > 1 - recall or any(missed(n, 1.0, runs, similarity, per_run) > 1 - recall for n in range(_least_size(similarity), SIZES + 1)):
        runs += 1
    return runs


@lru_cache
def parts_followed(similarity: float = SIMILARITY, recall: float = RECALL, per_run: float = PER_RUN) -> tuple[float, ...]:
    """By size (the last for all larger sets), the part of a level's chosen elements that a path goes on with. It never rises with the size, so that the larger
    of two sets decides."""
    runs = runs_needed(similarity, recall, per_run)
    out = [min(1.25 / runs, 1.0)]
    for size in range(SIZES, _least_size(similarity) - 1, -1):
        part = out[-1]
        while part < 1 and missed(size, part, runs, similarity, per_run) > 1 - recall:
            part = min(part * 1.02, 1.0)
        out.append(part)
    return (1.0,) * _least_size(similarity) + tuple(out[:0:-1]) + (out[0],)


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and their row, sorted by row and element. A text without words but not empty is one element."""
    buf, off = utf8(batch.column("text"))
    low = LOWER[buf]
    start, end, row = word_spans(low, off)
    h, rows = shingles(span_hash(prefix_hash(low), start, end), row, len(batch), words)
    bare = np.setdiff1d(np.flatnonzero(np.diff(off) > 0), np.unique(row))
    if len(bare):
        h = np.concatenate([h, span_hash(prefix_hash(buf), off[bare], off[bare + 1])])
        rows = np.concatenate([rows, bare])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]


MEMBERS = "doc_id long, k1 long, k2 long, s1 long, s2 long, size int, " + ", ".join(f"p{level} array<long>" for level in range(LEVELS)) + ", sketch binary"


def _members(words: int, runs: int):
    """mapInArrow: (doc_id, k1, k2, text) to MEMBERS. (s1, s2) names the set; null where it is empty. p0, p1, ... are the elements chosen at each level."""
    seeds = mix(np.arange(1, LEVELS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    sketch_seeds = mix(np.arange(1001, 1001 + SKETCH, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, row = _sets(batch, words)
            n = len(batch)
            size = np.bincount(row, minlength=n)
            have = np.flatnonzero(size)
            first = np.searchsorted(row, have)
            s1, s2 = np.zeros(n, U), np.zeros(n, U)
            sketch = np.zeros((n, SKETCH), np.uint8)
            paths = [pa.array([[]] * n, pa.list_(pa.int64()))] * LEVELS
            if len(h):
                s1[have] = mix(np.add.reduceat(h, first) ^ size[have].astype(U))
                s2[have] = mix(np.add.reduceat(mix(h ^ U(77)), first))
                for j in range(SKETCH):
                    sketch[have, j] = (mix(np.minimum.reduceat((h ^ sketch_seeds[j]) * U(0xD6E8FEB86659FD93), first)) & U(255)).astype(np.uint8)
                limit = (_chosen(np.maximum(size, 1), runs) * 2.0**32)[row]
                for level in range(LEVELS):
                    at = np.flatnonzero((mix(h ^ seeds[level]) >> U(32)).astype(np.float64) < limit)
                    paths[level] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)), pa.array(h[at].view(np.int64)))
            empty = size == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(s1.view(np.int64), mask=empty), pa.array(s2.view(np.int64), mask=empty), pa.array(size.astype(np.int32)),
                    *paths, pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "s1", "s2", "size", *(f"p{level}" for level in range(LEVELS)), "sketch"],
            )

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each connected part of a graph of n members."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def _pairs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within consecutive runs of rows, some rows at a time being the caller's business."""
    first = np.repeat(np.cumsum(count) - count, count)
    at = np.arange(int(count.sum()))
    later = np.repeat(count, count) - (at - first) - 1
    i = np.repeat(at, later)
    ends = np.cumsum(later)
    j = np.arange(int(later.sum())) - np.repeat(ends - later, later) + i + 1
    return i, j


def _sketched(similarity: float):
    """mapInArrow over members sorted by bucket: (s1, t1), each member that sketches link within a bucket and the least linked one."""
    least = (similarity - SKETCH_SLACK) * SKETCH

    def flush(tables: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(tables).combine_chunks()
        bucket = t.column("bucket").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(bucket), SKETCH)
        size = t.column("size").to_numpy()
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        count = np.diff(np.append(cut, len(bucket)))
        a, b = [], []
        for at, n in ((c, k) for c, k in zip(cut, count, strict=True) if k > BLOCK):
            for x in range(at, at + n, 64):
                own = sketch[x : min(x + 64, at + n)]
                same = np.zeros((len(own), at + n - x), np.int32)
                for j in range(SKETCH):
                    same += own[:, j, None] == sketch[None, x : at + n, j]
                u, v = np.nonzero(same >= least)
                a.append(u[u < v] + x)
                b.append(v[u < v] + x)
        few = np.where(count > BLOCK, 0, count)
        i, j = _pairs(few)
        rows = np.flatnonzero(np.repeat(count <= BLOCK, count))
        for x in range(0, len(i), 1 << 18):
            u, v = rows[i[x : x + (1 << 18)]], rows[j[x : x + (1 << 18)]]
            near = np.minimum(size[u], size[v]) >= (similarity - 1e-9) * np.maximum(size[u], size[v])
            u, v = u[near], v[near]
            linked = (sketch[u] == sketch[v]).sum(1) >= least
            a.append(u[linked])
            b.append(v[linked])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        label = _labels(len(bucket), a, b)
        kept = np.flatnonzero(np.bincount(label, minlength=len(bucket))[label] > 1)
        if not len(kept):
            return None
        kept = kept[label[kept] != kept]
        names = t.column("s1").to_numpy()
        _, once = np.unique(mix(names[kept].view(U)) + names[label[kept]].view(U), return_index=True)
        kept = kept[np.sort(once)]
        s1 = t.column("s1").combine_chunks()
        return pa.RecordBatch.from_arrays([s1.take(pa.array(kept)), s1.take(pa.array(label[kept]))], names=["s1", "t1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for table in groups(batches, "bucket"):
            held.append(table)
            rows += len(table)
            if rows > 4096:
                if (out := flush(held)) is not None:
                    yield out
                held, rows = [], 0
        if held and (out := flush(held)) is not None:
            yield out

    return run


def _intersections(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 blocks of 4,096 elements."""
    x, y = np.concatenate(first), np.concatenate(second)
    values, of = np.unique(np.concatenate([x, y]), return_inverse=True)
    both = np.intersect1d(np.unique(of[: len(x)]), np.unique(of[len(x) :]))
    slot = np.full(len(values), -1)
    slot[both] = np.arange(len(both))
    out = np.zeros((len(first), len(second)), np.float32)
    sx, sy = slot[of[: len(x)]], slot[of[len(x) :]]
    rx, ry = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (first, second))
    for k in range(0, len(both), 4096):
        n = min(4096, len(both) - k)
        a, b = np.zeros((len(first), n), np.float32), np.zeros((len(second), n), np.float32)
        mx, my = (sx >= k) & (sx < k + n), (sy >= k) & (sy < k + n)
        a[rx[mx], sx[mx] - k] = 1
        b[ry[my], sy[my] - k] = 1
        out += a @ b.T
    return out


def _verified(similarity: float):
    """mapInArrow over members of blocks of groups, sorted by block: (s1, s2, links, t1); links is a weight sum, t1 the least linked member."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        side = t.column("side").to_numpy()
        sets = [np.frombuffer(x, U) for x in t.column("elements").to_pylist()]
        weight = t.column("weight").to_numpy()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block of one part against itself
        if not len(one) or not len(two):
            return None
        size = np.array([len(x) for x in sets])
        inter = _intersections([sets[i] for i in one], [sets[j] for j in two])
        ok = inter >= similarity * (size[one][:, None] + size[two][None, :] - inter) - 1e-6
        ok &= one[:, None] != two[None, :]
        links = np.zeros(len(sets), np.int64)
        links[one] += (ok * weight[two][None, :]).sum(1).astype(np.int64)
        if len(side) and side[0] != 2:
            links[two] += (ok * weight[one][:, None]).sum(0).astype(np.int64)
        u, v = np.nonzero(ok)
        label = _labels(len(sets), one[u], two[v])
        kept = np.flatnonzero(links > 0)
        if not len(kept):
            return None
        s1, s2 = t.column("s1").combine_chunks(), t.column("s2").combine_chunks()
        take, to = pa.array(kept), pa.array(label[kept])
        return pa.RecordBatch.from_arrays([s1.take(take), s2.take(take), pa.array(links[kept]), s1.take(to)], names=["s1", "s2", "links", "t1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "block"):
            if (out := compare(table)) is not None:
                yield out

    return run


def both_ways(edges: DataFrame) -> DataFrame:
    """components of (s1, t1) pairs that stand once each."""
    return components(edges.unionByName(edges.select(F.col("t1").alias("s1"), F.col("s1").alias("t1"))))


def components(edges: DataFrame) -> DataFrame:
    """(s1, c1): c1 is the least s1 of each connected part. edges: (s1, t1) in both directions.

    Least labels travel along edges and then from each label's own label (pointer jumping), until a round changes none; every round is
    written to the shared folder, in as many partitions as its rows need.
    """
    edges = shared_table(edges)
    parts = edges.count() // LINKS + 1
    labels = shared_table(edges.groupBy("s1").agg(F.least(F.min("t1"), F.col("s1")).alias("c1")).coalesce(parts))
    while True:
        near = edges.join(labels.select(F.col("s1").alias("t1"), "c1"), "t1").groupBy("s1").agg(F.min("c1").alias("n1"))
        step = labels.join(near, "s1").select("s1", "c1", F.least("c1", "n1").alias("m1"))
        jump = step.select(F.col("s1").alias("m1"), F.col("m1").alias("j1"))
        least = F.least("m1", F.coalesce("j1", "m1"))
        new = shared_table(step.join(jump, "m1", "left").select("s1", least.alias("c1"), (least != F.col("c1")).alias("moved")).coalesce(parts))
        done = not new.where("moved").limit(1).count()
        labels = new.select("s1", "c1")
        if done:
            return labels


def _likeness(similarity: float):
    """mapInArrow: members of buckets with their pivot's sketch; `like`, whether sketches link the two."""
    least = (similarity - SKETCH_SLACK) * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), SKETCH) for c in ("sketch", "pivot"))
            kept = [c for c in batch.schema.names if c not in ("sketch", "pivot")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array((own == pivot).sum(1) >= least)], names=[*kept, "like"])

    return run


def _with_pivots(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(s1, s2, bucket, m, p1, like) of members of large buckets: p1 is the bucket's pivot, any of its members by one of four hashes, so that buckets share pivots and their links are the same, and `like` whether sketches link a member to it."""
    pivots = large.groupBy("bucket").agg(F.min_by("s1", F.xxhash64("s1", F.pmod("bucket", F.lit(4)))).alias("p1")).join(sets.select(F.col("s1").alias("p1"), F.col("sketch").alias("pivot")), "p1").dropDuplicates(["bucket"])
    rows = large.join(sets.select("s1", "s2", "sketch"), ["s1", "s2"]).join(pivots, "bucket").select("s1", "s2", "bucket", "m", "p1", "sketch", "pivot")
    return rows.mapInArrow(_likeness(similarity), "s1 long, s2 long, bucket long, m long, p1 long, like boolean")


def _buckets(ids: DataFrame, sets: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(s1, s2, bucket, m): the buckets to be compared and their sizes, by recursive splitting; and (s1, t1), links to pivots. A row is a member of a bucket, which the
    set of elements on its path names. Large buckets go on, each with its own part of the elements of the next level, but for those of which sketches link all members
    to the pivot except PART at most: their links connect them, and those few are compared with all members, so that no pair of the bucket is lost."""
    parts = parts_followed(similarity, recall)
    part = F.element_at(F.array(*(F.lit(int(p * 2**20) + 1) for p in parts)), F.least("size", F.lit(len(parts) - 1)) + 1)
    stays = F.col("size") < _least_size(similarity)
    out = stars = None
    rows = sets.select("s1", "s2", F.explode(F.array_distinct("p0")).alias("bucket"))
    for level in range(LEVELS):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        found = shared_table(rows.join(sizes, "bucket"))
        # buckets of the same members need one comparison only, but each goes on
        alike = found.groupBy("bucket").agg(F.first("m").alias("m"), F.bit_xor(F.xxhash64("s1", "s2")).alias("who"))
        once = alike.groupBy("m", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
        last = level == LEVELS - 1
        small = (found if last else found.where(F.col("m") <= SMALL)).join(once, "bucket", "left_semi").select("s1", "s2", "bucket", "m")
        out = small if out is None else out.unionByName(small)
        if last:
            return out, stars
        members = shared_table(_with_pivots(found.where(F.col("m") > SMALL).select("s1", "s2", "bucket", "m"), sets, similarity))
        dense = shared_table(members.groupBy("bucket").agg(F.count_if(~F.col("like")).alias("few")).where(F.col("few") <= PART))
        alone = members.join(dense.join(once, "bucket", "left_semi"), "bucket")
        linked = alone.where("like AND s1 != p1").select("s1", F.col("p1").alias("t1"))
        stars = linked if stars is None else stars.unionByName(linked)
        parts_of = F.ceil(F.col("m") / PART).cast("int")
        part_of = F.when(F.col("like"), F.array(F.pmod(F.xxhash64("s1", "s2"), parts_of).cast("int"))).otherwise(F.sequence(F.lit(0), parts_of - 1))
        held = alone.where("few > 0").select("s1", "s2", F.explode(part_of).alias("part"), "bucket").select("s1", "s2", F.xxhash64("bucket", "part").alias("bucket"), F.lit(2 * PART).cast("long").alias("m"))
        out = out.unionByName(held)
        path = F.array("bucket") if level == 0 else F.col("path")
        large = found.where(F.col("m") > SMALL).join(dense, "bucket", "left_anti").groupBy("s1", "s2").agg(F.collect_list(path).alias("b"))
        heads = large.join(sets.select("s1", "s2", "size", "head.k1", "head.k2"), ["s1", "s2"])
        chosen = ids.select("k1", "k2", F.array_distinct(f"p{level + 1}").alias("next"))
        pairs = heads.join(chosen, ["k1", "k2"]).dropDuplicates(["s1", "s2"]).select("s1", "s2", "b", "next", part.alias("part"), stays.alias("stays"))
        picked = lambda p, x: ~F.array_contains(p, x) & (F.pmod(F.xxhash64(F.lit(level), p, x), F.lit(2**20)) < F.col("part"))
        longer = lambda p: F.transform(F.filter("next", lambda x: picked(p, x)), lambda x: F.array_sort(F.concat(p, F.array(x))))
        onward = F.concat(F.flatten(F.transform("b", longer)), F.when(F.col("stays"), F.col("b")).otherwise(F.slice("b", 1, 0)))
        rows = pairs.select("s1", "s2", F.explode(F.array_distinct(onward)).alias("path")).withColumn("bucket", F.xxhash64("path"))


def _linked(docs: DataFrame, similarity: float, recall: float, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, s1, s2), where (k1, k2) names a row by its id and text; and sets (s1, s2, n_links, first), first being the first row of the
    set's class: doc_id, null last, then k1 and k2."""
    short_batches(docs.sparkSession)
    runs = runs_needed(similarity, recall)
    k1, k2 = row_name(F.col(id_col).cast("long"), F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    ids = shared_table(own.mapInArrow(_members(words, runs), MEMBERS))
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    sets = ids.where("s1 is not null").groupBy("s1", "s2").agg(
        F.count("*").alias("weight"), F.min(head).alias("head"), F.first("size").alias("size"), F.first("p0").alias("p0"), F.first("sketch").alias("sketch")
    )
    sets = shared_table(sets)

    buckets, near = _buckets(ids, sets, similarity, recall)
    # what is still large after the last level is compared in blocks of two parts
    huge = buckets.where(F.col("m") > 2 * PART).withColumn("k", F.ceil(F.col("m") / PART).cast("int")).withColumn("p", F.pmod(F.xxhash64("s1", "s2", "bucket"), F.col("k")).cast("int"))
    split = huge.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("s1", "s2", F.xxhash64("bucket", F.least("p", "other"), F.greatest("p", "other")).alias("bucket"))
    dealt = buckets.where(F.col("m") <= 2 * PART).select("s1", "s2", "bucket").unionByName(split)
    members = dealt.join(sets.select("s1", "s2", "size", "sketch"), ["s1", "s2"])
    stars = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sketched(similarity), "s1 long, t1 long").unionByName(near).distinct()
    group_of = both_ways(stars)
    group_size = group_of.groupBy("c1").agg(F.count("*").alias("m"))

    # elements of the linked sets, from the text of their first rows
    wanted = sets.select("s1", "s2", "weight", "head.k1", "head.k2").join(group_of.join(group_size, "c1"), "s1")
    elements = own.select("k1", "k2", "text").join(wanted.select("k1", "k2", "s1", "s2"), ["k1", "k2"]).select("s1", "s2", "text").mapInArrow(_elements(words), "s1 long, s2 long, elements binary").dropDuplicates(["s1", "s2"])
    whole = wanted.join(elements, ["s1", "s2"]).withColumn("k", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = whole.withColumn("p", F.pmod(F.xxhash64("s1", "s2"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = dealt.select(
        "s1", "s2", "weight", "elements", F.xxhash64("c1", F.least("p", "other"), F.greatest("p", "other")).alias("block"),
        F.when(F.col("p") == F.col("other"), 2).when(F.col("p") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    counted = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_verified(similarity), "s1 long, s2 long, links long, t1 long")
    counted = shared_table(counted)
    links = counted.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    label = both_ways(counted.where("s1 != t1").select("s1", "t1").distinct())
    classes = sets.select("s1", "s2", "weight", "head").join(links, ["s1", "s2"], "left").join(label, "s1", "left").withColumn("c1", F.coalesce("c1", "s1"))
    first = classes.groupBy("c1").agg(F.min("head").alias("first"))
    per_set = classes.join(first, "c1").select("s1", "s2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first")
    return ids.select("doc_id", "k1", "k2", "s1", "s2"), per_set


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its class and its number of links.

    Returns per row of docs: doc_id, class_id (least doc_id of all documents that links connect to it), n_links (other documents of similarity
    `similarity` or more, copies included). Elements are runs of `words` words (lower-case A-Z; digits, letters and non-ASCII characters); fewer words, but
    not none, are one element; a text without words that is not empty is one element of its own characters. Null and empty texts have no links and each is a class
    of its own, as is a document of a null id that has no links. Repeated rows are links of each other. Other columns are ignored.
    """
    ids, per_set = _linked(docs, similarity, recall, words, id_col, text_col)
    found = ids.select("doc_id", "s1", "s2").join(per_set.select("s1", "s2", "n_links", F.col("first.doc_id").alias("class_id")), ["s1", "s2"], "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of every class of similar_documents the row of the least doc_id (null last; ties
    by a hash of the text). Rows are told apart by id and text, so an id that stands on several texts loses none of them to another class; rows that agree in
    both are one, of which any stays. Null and empty texts are no duplicates of other ids. An empty table gives no rows."""
    ids, per_set = _linked(docs, similarity, recall, words, id_col, text_col)
    heads = per_set.select("first.k1", "first.k2").unionByName(ids.where("s1 is null").select("k1", "k2")).distinct()
    k1, k2 = row_name(F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.dropDuplicates(["k1", "k2"]).join(heads, ["k1", "k2"], "left_semi").select("row.*")


def _elements(words: int):
    """mapInArrow: (s1, s2, text) to (s1, s2, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, row = _sets(batch, words)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["s1", "s2", "elements"])

    return run


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Links of all documents of five-word similarity 0.8 or more."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
