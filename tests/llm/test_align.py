"""Alignment against loops over the tokens of each document."""

import hashlib
import json
from collections import Counter

from strikeline.llm import align


def plain(texts):
    """Measures of each text, with the tokenizers' own calls and sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.default_files()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    entry = {i: t for t, i in json.load(open(path_a))["model"]["vocab"].items()}
    bytes_a = lambda i: bytes(letters[c] for c in entry[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        if text and any(b"".join(map(f, x)) != (" " + text).encode() for f, x in zip((bytes_a, bytes_b), ids, strict=True)):
            ids = [[], []]
        ends = []
        for f, x in zip((bytes_a, bytes_b), ids, strict=True):
            at = 0
            ends.append([at := at + len(f(i)) for i in x])
        common = sorted(set(ends[0]) & set(ends[1]))
        own = [(i, j) for i, x in zip(ids[0], ends[0], strict=True) for j, y in zip(ids[1], ends[1], strict=True) if x == y] if len(common) < 500 else None
        own = own if own is not None else [(ids[0][ends[0].index(x)], ids[1][ends[1].index(x)]) for x in common]
        groups, before = [], 0
        for x in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[k], ends[k], strict=True) if before < e <= x) for k in (0, 1)))
            before = x
        links.append(own)
        out.append([len(ids[0]), len(ids[1]), len(common), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(x for own in links for x in own)
    highest = Counter()
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    return [(o[0], o[1], o[2], o[3], sum(count[x] == highest[x[1]] for x in own), sum(count[x] for x in own), o[4]) for o, own in zip(out, links, strict=True)]


TEXTS = [
    "Hello world, tokenizers disagree.", "Hello world, tokenizers disagree.", None, "", " ", "   leading and  double   spaces ", "line\nfeeds\n\n and\ttabs\r\n", "naïve café 北京市 mañana Straße", "🤖🤖 emoji 👩‍🔬",
    "a ▁ mark", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01 control", "é decomposed", "x" * 300, "1234567890 12.5e-7", "don't we'll they're", "supercalifragilistic " * 40, "　ideographic\xa0spaces ", "ﬁ ligature ﷺ",
]


def test_equal_plain_alignment(spark):
    docs = [(i if i != 3 else None, t, "kept") for i, t in enumerate(TEXTS + TEXTS[:1] * 5)]
    want = plain([d[1] for d in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string, key string").repartition(3)
    got = align.alignment(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=key) == sorted(((d[0], *w) for d, w in zip(docs, want, strict=True)), key=key)
    assert any(w[0] == 0 for d, w in zip(docs, want, strict=True) if d[1])  # the space mark in a text is not given back


def test_whole_table_of_many_chunks(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain([r.text for r in rows])
    got = align.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(r.doc_id, *w) for r, w in zip(rows, want, strict=True)]


def test_empty_table_and_very_long_texts(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "ab" * 400_000
    got = align.alignment(spark.createDataFrame([(1, text), (2, "word " * 300_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_a > 1000 and r.n_links == r.n_groups > 0 for r in got] == [True, True]


def test_files_of_other_kinds_use_their_own_library(tmp_path):
    """Merges that do not make ids in order are not taken for ranks."""
    path_a, path_b = align.default_files()
    spec = json.load(open(path_a))
    spec["model"]["merges"] = spec["model"]["merges"][:1000][::-1]
    (tmp_path / "a.json").write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(str(tmp_path / "a.json"))
    encode, _ = align._encoder_a(str(tmp_path / "a.json"))
    assert encode(" the other") == own.encode(" the other", add_special_tokens=False).ids


def test_pairs_that_can_be_linked_are_suffixes():
    pair = align.tokenizers(*align.default_files())
    assert len(pair.keys) < 10 * (len(pair.bytes_a) + len(pair.bytes_b))
    for key in pair.keys[:: len(pair.keys) // 50]:
        a, b = pair.bytes_a[key // len(pair.bytes_b)], pair.bytes_b[key % len(pair.bytes_b)]
        assert a.endswith(b) or b.endswith(a)
