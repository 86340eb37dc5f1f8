"""Segmentations against an enumeration of all of them, and text without spaces."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa

from strikeline.llm import pieces
from strikeline.llm.vectors import utf8

VOCABULARY = pieces.Vocabulary.load(pieces.default_model())


def piece_weights():
    """Every piece's text and log-weight, read from the model itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i).replace("▁", " "): (i, -math.log(10 - model.get_score(i))) for i in plain}


WEIGHTS = piece_weights()
BYTE = -math.log(32010)


def enumerated(text):
    """All ways to cut a text into pieces, with their probabilities. Pieces do not cross the start of a run of spaces or a line feed."""
    text = " " + text

    def crosses(p):
        return any((p[k] == " " and p[k - 1] != " ") or p[k] == "\n" or p[k - 1] == "\n" for k in range(1, len(p)))

    def ways(at):
        if at == len(text):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(text) + 1):
            p = text[at:end]
            if p in WEIGHTS and not crosses(p):
                out.append(((WEIGHTS[p][0],), WEIGHTS[p][1], end))
        if text[at] not in WEIGHTS:
            raw = text[at].encode()
            out.append((tuple(pieces.FIRST_BYTE + b for b in raw), BYTE * len(raw), at + 1))
        return [(ids + rest, w + more) for ids, w, end in out for rest, more in ways(end)]

    every = ways(0)
    top = max(w for _, w in every)
    total = sum(math.exp(w - top) for _, w in every)
    return {ids: math.exp(w - top) / total for ids, w in every}


def drawn(text, seeds, k):
    n = len(seeds)
    return pieces.segmentations(VOCABULARY, *utf8(pa.array([text] * n, pa.large_string())), np.arange(n) + seeds.start, k)


def test_all_segmentations_of_short_texts():
    for text in ("ab", "the", "a b", "日本", "x\ny", "é!", "  a"):
        exact = enumerated(text)
        found = drawn(text, range(1), len(exact) + 5)[0]
        assert {tuple(ids.tolist()): None for ids, *_ in found}.keys() == exact.keys(), text
        for ids, log_p, *_ in found:
            assert abs(math.exp(log_p) - exact[tuple(ids.tolist())]) < 1e-4, text
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)


def test_first_samples_are_drawn_by_probability_and_second_ones_from_the_rest():
    exact = enumerated("then")
    found = drawn("then", range(100, 6100), 2)
    first, both = {}, {}
    for (a, *_), (b, *_) in found:
        x, y = tuple(a.tolist()), tuple(b.tolist())
        first[x] = first.get(x, 0) + 1
        both[x, y] = both.get((x, y), 0) + 1
    for x, p in exact.items():
        assert abs(first.get(x, 0) / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000) + 1e-3
    for x, y in itertools.permutations(exact, 2):
        p = exact[x] * exact[y] / (1 - exact[x])
        assert abs(both.get((x, y), 0) / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-3


def test_text_without_spaces(monkeypatch):
    rng = random.Random(1)
    signs = [p for p in WEIGHTS if len(p) == 1 and ord(p) > 0x3000] + ["the", "ing"]
    text = "".join(rng.choice(signs) for _ in range(80_000))
    began = time.process_time()
    found = drawn(text, range(1), 2)[0]
    assert len({tuple(ids.tolist()) for ids, *_ in found}) == 2 and all(VOCABULARY.decode(ids).decode() == text for ids, *_ in found)
    assert time.process_time() - began < 20
    # cuts change no probability
    short = "".join(rng.choice(signs) for _ in range(20)) + "then" + "".join(rng.choice(signs[:-2]) for _ in range(8))
    seen = []
    for long in (4, 10**6):
        monkeypatch.setattr(pieces, "LONG", long)
        seen.append({tuple(ids.tolist()): log_p for doc in drawn(short, range(300), 1) for ids, log_p, *_ in doc})
    both = seen[0].keys() & seen[1].keys()
    assert len(both) > 1 and all(abs(seen[0][x] - seen[1][x]) < 1e-2 for x in both)


def test_op9_returns_the_ids(spark):
    import hashlib

    rows = pieces.op9_sentencepiece_sampling(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        ids = np.array(r.ids, "<i4")
        assert r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.round_trip


def test_digests_decode_a_chunk_at_once(monkeypatch):
    import hashlib

    texts = ["", "a b", "日本 é!", "  two\nlines ", "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, None, 7, 9], pa.int64()), pa.array(texts, pa.string()), pa.array(range(5), pa.int64())], names=["doc_id", "text", "seed"])
    alone = pieces.Vocabulary.decode
    monkeypatch.setattr(pieces.Vocabulary, "decode", lambda *_: 1 / 0)
    out = pieces.digests(VOCABULARY, batch, 2).to_pylist()
    assert [(r["doc_id"], r["sample"]) for r in out] == [(3, 0), (1, 0), (1, 1), (None, 0), (None, 1), (7, 0), (7, 1), (9, 0), (9, 1)]
    want = dict(zip([3, 1, None, 7, 9], texts, strict=True))
    for r in out:
        ids = np.array(r["ids"], np.int64)
        assert r["round_trip"] and alone(VOCABULARY, ids).decode() == want[r["doc_id"]]
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
