"""Hard negatives against loops over all pairs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strikeline.llm import negatives


def plain(rows):
    """rows: (id, label, vector). What the contract asks for, with Python's whole numbers."""
    used = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(used):
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, z, w) in enumerate(used) if n != k]  # noqa: B905
        for s, p, _ in sorted(x for x in score if x[2] == y)[:5]:
            hard = sorted(x for x in score if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def run(spark, rows, is_anchor=None):
    df = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id long, label int, embedding array<float>, id string")
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def vectors(n, seed, dim=6, kinds=3):
    """Coarse components, so that scores tie."""
    rng = random.Random(seed)
    return [(i, rng.randrange(kinds), [rng.randrange(-2, 6) / 8 for _ in range(dim)]) for i in range(n)]


def test_equal_plain_loops_over_many_cells(spark, monkeypatch):
    for name, value in (("CELL_ANCHORS", 3), ("BLOCK_ROWS", 32), ("LEAST_ROWS", 64)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(900, 1)
    got = run(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_nulls_ties_copies_and_lengths(spark):
    rows = vectors(300, 2)
    rows += [(None, 1, [1.0] * 6), (400, None, [1.0] * 6), (500, 1, None), (600, 1, [1.0, None]), (700, 1, [float("nan")]), (800, 1, [float("inf")]), (900, 1, []), (1000, 1, [0.5, 0.5]), (1100, 2, [0.5] * 9)]
    rows += [rows[100], rows[100], (100, 2, [0.5] * 6), (100, rows[100][1], [0.75] * 6)] + [(2000 + i, 1, [0.25] * 6) for i in range(200)]
    assert run(spark, rows) == plain(rows)


def test_scores_beyond_exact_doubles(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), [float(rng.randrange(1 << 22)) for _ in range(3)]) for i in range(120)]
    got = run(spark, rows)
    assert got == plain(rows) and max(r[4] for r in got) > 1 << 53
    huge = [(0, 1, [3e38]), (1, 1, [3e38]), (2, 0, [2.9e38])]
    assert run(spark, huge) == [(0, 1, 1, 2, negatives.LONG, negatives.LONG)]


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [-1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [1.0])]) == [(0, 1, 1, 2, 65536, 65536)]


@pytest.mark.parametrize("rows", [vectors(500, 4)])
def test_sql_gives_the_same(spark, rows):
    import pandas as pd

    embeddings = pd.DataFrame(rows, columns=["vec_id", "label", "embedding"])
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = con.sql(negatives.OP12_SQL).fetchall()
    changed = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(want) == plain(changed) == run(spark, changed)
