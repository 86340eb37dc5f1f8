"""Hard-negative mining with exact scores, by slots.

Anchors (a stated query set) meet all rows in a grid: rows in `across` groups, anchors in `down` groups of at most CELL_ANCHORS, one cell for each pair
of groups, so that a task holds one group of anchors and reads its rows as a stream. Two passes:

1. Positives: a cell keeps the best rows of each anchor's own label, and the best of all cells are an anchor's positives.
2. Negatives: the positives' scores are the upper limits of overlapping windows. In descending order they cut scores into disjoint slots; a cell keeps
   the best TOP rows of other labels for each slot, and those of all cells are merged by slot. What a window asks for is then found in its own slot and
   those after it: the slots' rows in descending order, from the window's slot on, are its answer as far as they reach its lower limit.

Scores are integer inner products. Matrix products of doubles are exact while every sum stays below 2**53; beyond, whole numbers of any size are used, and a
score of more than 64 bits counts as the nearest that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.llm.vectors import shared_table

TOP = 5
#: Anchors of a cell and rows that a cell scores at a time.
CELL_ANCHORS, BLOCK_ROWS = 1024, 2048
#: Rows of a cell: as few as keep all cores at work, and so many at most.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 20
EXACT, LONG = float(1 << 53), (1 << 63) - 1
LOW = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and vector of rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("vector"))


def whole_components(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(256 * x) of every component as doubles, which are whole; shorter vectors are filled up with zeros, longer ones cut by a dim of the other side."""
    n, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dim).all():
        return np.floor(flat.reshape(len(n), dim) * 256.0)
    out = np.zeros((len(n), dim))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    fits = place < dim
    out[np.repeat(np.arange(len(n)), n)[fits], place[fits]] = flat[fits]
    return np.floor(out * 256.0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles as 64-bit numbers; one beyond those counts as the nearest that fits."""
    most = np.abs(a).sum(1).max(initial=0.0) * np.abs(b).max(initial=0.0)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a).dot(whole(b).T), -LONG, LONG).astype(np.int64)


class Best:
    """The best rows of each anchor and slot: by score descending, then id. Only rows that can still be among them are sorted."""

    def __init__(self, k: int, n: int):
        self.k, self.full = k, [None] * n
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, fits: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """floor: the least score that can matter for each anchor; it is given back as it is then."""
        fits = fits & (s >= floor[:, None])
        if s.shape[1] > self.k:
            least = np.partition(np.where(fits, s, LOW), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            fits &= s >= least[:, None]
        row, col = np.nonzero(fits)
        if len(row):
            at, score, who = np.concatenate([self.at, row]), np.concatenate([self.score, s[row, col]]), np.concatenate([self.id, ids[col]])
            order = np.lexsort((who, -score, at))
            at, score, who = at[order], score[order], who[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            keep = rank < self.k
            self.at, self.score, self.id = at[keep], score[keep], who[keep]
            last = rank[keep] == self.k - 1
            floor = floor.copy()
            floor[self.at[last]] = np.maximum(floor[self.at[last]], self.score[last])
        return floor


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Parts of batches with one cell and kind, at most BLOCK_ROWS rows each; anchors come before rows."""
    for batch in batches:
        cell, kind = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
            for x in range(a, b, BLOCK_ROWS):
                yield int(cell[x]), bool(kind[x]), batch.slice(x, min(BLOCK_ROWS, b - x))


def _scan(batches: Iterator[pa.RecordBatch], slots: bool) -> Iterator[pa.RecordBatch]:
    """What each cell keeps: (anchor, slot, id, score). Without slots: of the anchor's label, one more than TOP, since the anchor may be among them, and
    as slot 1 the anchor's score with itself."""
    now, anchors, held = None, [], None

    def kept() -> Iterator[pa.RecordBatch]:
        for k, best in enumerate(held[3] if held else ()):
            if len(best.at):
                yield pa.RecordBatch.from_arrays([pa.array(held[0][best.at]), pa.array(np.full(len(best.at), k), pa.int32()), pa.array(best.id), pa.array(best.score)], ["anchor", "slot", "id", "score"])

    for cell, is_row, part in _cells(batches):
        if cell != now:
            yield from kept()
            now, anchors, held = cell, [], None
        if not is_row:
            anchors.append(part)
            continue
        if held is None:
            if not anchors:
                continue
            t = pa.Table.from_batches(anchors).combine_chunks()
            vectors = t.column("vector").chunk(0)
            dim = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
            name, label = t.column("anchor").to_numpy(), t.column("label").to_numpy()
            limits = [np.array([u[k] if k < len(u) else LOW for u in t.column("limits").to_pylist()], np.int64) for k in range(TOP)] if slots else []
            floors = [least_above(u) for u in limits] or [np.full(len(name), LOW)]
            vectors = whole_components(vectors, dim)
            if not slots:
                own = np.array([scores(v[None], v[None])[0, 0] for v in vectors])
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.ones(len(name), np.int32)), pa.array(np.zeros(len(name), np.int64)), pa.array(own)], ["anchor", "slot", "id", "score"])
            held = (name, vectors, label, [Best(TOP if slots else TOP + 1, len(name)) for _ in floors], dim)
        name, a, label, bests, dim = held
        ids, same = part.column("id").to_numpy(), label[:, None] == part.column("label").to_numpy()[None, :]
        s = scores(a, whole_components(part.column("vector"), dim))
        if not slots:
            floors[0] = bests[0].add(s, same, ids, floors[0])
            continue
        for k, best in enumerate(bests):
            fits = ~same & (s <= limits[k][:, None]) & (limits[k] != LOW)[:, None]
            if k + 1 < TOP:
                fits &= s > limits[k + 1][:, None]
            floors[k] = best.add(s, fits, ids, floors[k])
    yield from kept()


def least_above(limit: np.ndarray) -> np.ndarray:
    """The least score with 100 * score >= 80 * limit."""
    return np.array([-((-4 * int(u)) // 5) if u != LOW else LOW for u in limit], object).astype(np.int64)


def _grid(rows: DataFrame, anchors: DataFrame, across: int, down: int, slots: bool) -> DataFrame:
    cell = lambda row, group: (row * F.lit(down) + group).cast("long")
    limits = F.col("limits") if slots else F.lit(None).cast("array<bigint>").alias("limits")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    left = anchors.select("*", every(across)).select(cell(F.col("other"), F.col("group")).alias("cell"), F.lit(False).alias("is_row"), "anchor", F.lit(None).cast("long").alias("id"), "label", "vector", limits)
    right = rows.select("*", every(down)).select(
        cell(F.col("part"), F.col("other")).alias("cell"), F.lit(True).alias("is_row"), F.lit(None).cast("long").alias("anchor"), "id", "label", "vector", F.lit(None).cast("array<bigint>").alias("limits")
    )
    dealt = left.unionByName(right).repartition(across * down, "cell").sortWithinPartitions("cell", "is_row")
    return dealt.mapInArrow(lambda it: _scan(it, slots), "anchor long, slot int, id long, score long")


def best_of_cells(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and slot over all cells; Spark keeps k of each before the shuffle too."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row for each anchor, positive and negative found: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on `id`. Rows with a null id, label or vector, or a component that is null or not finite, take no part; a shorter vector counts as filled
    up with zeros. Equal scores come by id. Repeated rows are rows of their own: a copy of an anchor is another row of its label, and each copy of an
    anchor gives its own rows. No anchors, or no row of another label within a window, give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    used = shared_table(usable(rows, id_col, label_col, vector_col))
    n, n_anchors = (used.agg(F.count("*"), F.count_if(is_anchor)).first()) or (0, 0)
    down = max(1, -(-n_anchors // CELL_ANCHORS))
    across = max(1, -(-n // MOST_ROWS), min(-(-n // LEAST_ROWS), -(-2 * spark.sparkContext.defaultParallelism // down)))
    # numbers of stored rows: a task that runs again finds the same ones
    used = used.withColumn("part", (F.monotonically_increasing_id() % across).cast("int"))
    anchors = shared_table(used.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()).withColumn("group", (F.xxhash64("anchor") % down + down) % down))

    near = best_of_cells(_grid(used, anchors, across, down, False), TOP + 1)
    pair = F.struct((-F.col("score")).alias("s"), "id")
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.when(F.col("slot") == 0, pair))).alias("near"), F.max(F.when(F.col("slot") == 1, -F.col("score"))).alias("own"))  # TOP + 1 at most
    # the anchor itself is a row of its id and of its score with itself; rows that agree in both are alike here
    with_near = anchors.join(near, "anchor")
    own = F.array_position(F.col("near"), F.struct(F.col("own").alias("s"), "id")).cast("int")
    others = F.filter("near", lambda x, i: i + 1 != own)
    positives = shared_table(with_near.withColumn("positives", F.slice(others, 1, TOP)).withColumn("limits", F.transform("positives", lambda x: -x["s"])).drop("near", "own"))

    kept = best_of_cells(_grid(used, positives.drop("positives").where(F.size("limits") > 0), across, down, True), TOP)
    # slots descend, so all rows of an anchor by score are its slots in order, and a window's are the rest from its own slot on
    merged = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "slot"))).alias("kept"))  # TOP * TOP at most
    out = positives.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive")).join(merged, "anchor")
    score = lambda x: -x["s"]
    rest = F.slice(F.filter("kept", lambda x: score(x) <= -F.col("positive.s")), 1, TOP)
    answer = F.filter(rest, lambda x: F.lit(100).cast("decimal(38,0)") * score(x) >= F.lit(80).cast("decimal(38,0)") * -F.col("positive.s"))
    out = out.select("anchor_id", F.col("positive.id").alias("positive_id"), (-F.col("positive.s")).alias("positive_score"), F.posexplode(answer).alias("k", "negative"))
    return out.select("anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", score(F.col("negative")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors (ids divisible by 100) among all embeddings; ids divisible by 7 have a wrong label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


#: Whole numbers as HUGEINT, in all pairs of anchors and rows.
OP12_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1], 0)::HUGEINT * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM used a, used r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score::HUGEINT <= 100 * s.score::HUGEINT AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
