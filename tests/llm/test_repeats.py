"""Repeated strings and passages against direct counts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strikeline.llm import suffixes
from strikeline.llm.suffixes import Rule

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def passages(rows, length, across):
    """(spans, bytes) of each row (id, text), by a direct count of all windows; a span is of consecutive words."""
    own = []
    for i, t in rows:
        data = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        own.append(((i, t), [(m.start(), m.end(), m.group()) for m in WORD.finditer(data)], len(data)))
    where = {}
    for n, (key, ws, _) in enumerate(own):
        for p in range(len(ws) - length + 1):
            where.setdefault(tuple(w for *_, w in ws[p : p + length]), []).append((key, n, p))
    out = []
    for _, ws, _ in own:
        hit = set()
        for p in range(len(ws) - length + 1):
            found = where[tuple(w for *_, w in ws[p : p + length])]
            if len({k for k, *_ in found} if across else found) > 1:
                hit.update(range(p, p + length))
        begin, end = [ws[k][0] for k in sorted(hit) if k - 1 not in hit], [ws[k][1] for k in sorted(hit) if k + 1 not in hit]
        out.append((len(begin), sum(end) - sum(begin)))
    return out


@pytest.mark.parametrize(("in_memory", "slice_", "across"), [(4096, 4 << 20, True), (2, 64, True), (3, 50, False)])
def test_passages_equal_brute_force(spark, monkeypatch, in_memory, slice_, across):
    monkeypatch.setattr(suffixes, "IN_MEMORY", in_memory)
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    rng = random.Random(5)
    shared, line = words(rng, 40, 900), words(rng, 14, 900)
    rows = [(None, None), (1, ""), (2, "one"), (3, "漢字"), (4, f"{line}. {line}, {line}! {line}"), (5, words(rng, 400, 2)), (6, shared), (6, shared.upper())]
    rows += [(k, f"{words(rng, 20, 900)}; {shared[5 * k : 90 + 5 * k].replace(' ', ' - ')} {words(rng, 8, 900)} {line}") for k in range(7, 16)]
    rows += [(None, shared + " " + words(rng, 3)), (None, shared), (17, line + " " + words(rng, 30)), (17, line + " " + words(rng, 30)), (18, "é" * 40 + " " + words(rng, 300, 900)), (6, shared)]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, passage_bytes int").repartition(3)
    got = {r.row.passage_bytes: (r.n_passages, r.passage_bytes) for r in suffixes.remove_repeats(d, 60, report=Rule("word", 12, across)).select("row", "n_passages", "passage_bytes").collect()}
    assert [got[k] for k in range(len(rows))] == passages(rows, 12, across)


@pytest.mark.parametrize("slice_", [4 << 20, 40])
def test_strings_equal_brute_force_in_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    monkeypatch.setattr(suffixes, "IN_MEMORY", 2)
    rng = random.Random(8)
    shared = words(rng, 60, 900)
    texts = ["a" * 300, "ab" * 120, shared, words(rng, 9) + shared[30:], words(rng, 150, 2), shared[:100] + "漢" + shared[103:], "é" * 90]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(d, 30).collect()}
    assert got == suffixes.brute_force(dict(enumerate(texts)), 30)


def test_many_null_ids(spark):
    """Rows without an id are told apart by their whole texts."""
    texts = [f"{k:05d} " * 12 for k in range(300)]
    d = spark.createDataFrame([(None, t) for t in texts + texts[:40]], "doc_id long, text string")
    got = suffixes.remove_repeats(d, 50).groupBy("text").agg(F.max("n_removed").alias("n"), F.count("*").alias("rows")).collect()
    # "00000 00000 ..." repeats within its own text too
    assert all(r.n == 72 for r in got) and sum(r.rows for r in got) == 340


def test_a_passage_of_short_words_goes(spark):
    """55 words of 320 bytes, shorter than the strings of 400 bytes."""
    rng = random.Random(3)
    planted = words(rng, 55, 9000)
    assert len(planted) < 400
    rows = [(k, f"{words(rng, 60, 10**6)}. {planted} {words(rng, 60, 10**6)}") for k in range(3)] + [(9, words(rng, 200, 10**6))]
    got = {r.row.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rule=suffixes.PASSAGES).collect()}
    assert all(planted not in got[k].kept_text and got[k].n_spans == 1 and got[k].n_removed == len(planted) for k in range(3))
    assert got[9].n_removed == 0 and got[9].kept_text == rows[3][1]
