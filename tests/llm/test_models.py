"""Models and scans against plain loops."""

import math
import random
import time

import numpy as np
import pytest

from strikeline.llm import html, langid, quality


# --- op3 ---------------------------------------------------------------------------------------------------------------------


def em(words, share, rounds):
    """Shares after some rounds, and the log-likelihood of the words under them."""
    for _ in range(rounds):
        total = [0.0] * len(share)
        for w in words:
            p = [s * math.exp(x) for s, x in zip(share, w, strict=True)]
            for k, x in enumerate(p):
                total[k] += x / sum(p)
        share = [x / len(words) for x in total]
    return share, sum(math.log(sum(s * math.exp(x) for s, x in zip(share, w, strict=True))) for w in words)


def mixture(words, penalty, rounds):
    """The language that alone is best, then, in the order of a first estimate, each further one that raises the likelihood by more than its penalty."""
    n = len(words[0])
    alone = [sum(w[k] for w in words) for k in range(n)]
    first, _ = em(words, [1 / n] * n, 2)
    first[alone.index(max(alone))] = 2
    order = sorted(range(n), key=lambda k: (-first[k], k))
    share, best = [float(k == order[0]) for k in range(n)], max(alone)
    for size in range(2, n + 1):
        found, value = em(words, [1 / size if k in order[:size] else 0.0 for k in range(n)], rounds)
        if value - best <= penalty * math.log(len(words) + 1):
            break
        share, best = found, value
    return share


@pytest.mark.parametrize("penalty", [0.5, langid.PENALTY])
def test_mixtures_equal_plain_expectation_maximisation(penalty):
    rng = random.Random(4)
    documents = []
    for k in range(40):
        spoken = rng.sample(range(4), 1 + k % 3)
        documents.append([[-6 - 4 * rng.random() - (0 if x == own else 5 * rng.random()) for x in range(4)] for own in (rng.choice(spoken) for _ in range(1 + rng.randrange(60)))])
    ll = np.array([w for d in documents for w in d], np.float32)
    first = np.cumsum([0] + [len(d) for d in documents[:-1]])
    got = langid.mixture(ll, first, penalty)
    sizes = set()
    for row, words in zip(got, documents, strict=True):
        want = mixture(words, penalty, langid.ROUNDS)
        sizes.add(sum(x > 0 for x in want))
        assert row == pytest.approx(want, abs=2e-3)
    assert len(sizes) > 1


# --- op4 ---------------------------------------------------------------------------------------------------------------------


def test_attention_equals_plain_loops():
    rng = np.random.default_rng(3)
    s = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    m = quality.Model(s(6, 4), s(4), s(4, 3), s(4, 3), s(3), s(4), np.array(0.3, np.float32))
    x, first = s(9, 6), np.array([0, 1, 5])
    want = []
    for a, b in zip([0, 1, 5], [1, 5, 9], strict=True):
        h = [[math.tanh(sum(x[i][f] * m.w[f][j] for f in range(6)) + m.b[j]) for j in range(4)] for i in range(a, b)]
        gate = []
        for row in h:
            t = [math.tanh(sum(row[j] * m.v[j][g] for j in range(4))) for g in range(3)]
            u = [1 / (1 + math.exp(-sum(row[j] * m.u[j][g] for j in range(4)))) for g in range(3)]
            gate.append(math.exp(sum(m.a[g] * t[g] * u[g] for g in range(3))))
        z = [sum(w * row[j] for w, row in zip(gate, h, strict=True)) / sum(gate) for j in range(4)]
        want.append(1 / (1 + math.exp(-(sum(z[j] * m.c[j] for j in range(4)) + 0.3))))
    assert m.forward(x, first)[0] == pytest.approx(want, abs=1e-5)


def test_training_sample_of_repeated_ids(spark, monkeypatch):
    """An id of many rows does not push others out of the sample in another way from run to run."""
    monkeypatch.setattr(quality, "BATCH_BYTES", 2000)
    rows = [(k, ("good text here " if k % 2 else "b@d t3xt h3r3 ") * (30 + 200 * (k == 5))) for k in range(40)] + [(7, f"one id, text {k} " * 20) for k in range(60)] + [(None, "no id"), (3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int")
    one, two = (quality.train(d, labels, sample=30) for d in (docs.repartition(3), docs.repartition(2)))
    assert all(np.array_equal(a, b) for a, b in zip(one.parts(), two.parts(), strict=True))
    assert quality.train(docs, labels.limit(0)) is None and quality.train(docs.limit(0), labels) is None
    empty = quality.score(docs.limit(0), one)
    assert empty.columns == ["doc_id", "text", "score", "n_passages"] and empty.count() == 0
    scores = {r.doc_id: r.score for r in quality.score(docs.where("doc_id < 3"), one).collect()}
    assert scores[1] > scores[0]


# --- op10 --------------------------------------------------------------------------------------------------------------------


def test_best_run_equals_all_runs():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 30):
        for _ in range(40):
            x = [float(rng.randrange(-4, 4)) for _ in range(n)]
            sums = {(a, b): sum(x[a:b]) for a in range(n) for b in range(a + 1, n + 1)}
            most = max(sums.values(), default=0.0)
            a, b = html.best_run(x)
            assert (a, b) == (0, 0) if most <= 0 else sums[a, b] == most and b == min(e for (_, e), v in sums.items() if v == most)


PAGE = "<html><body><nav>Menu here</nav>{}<footer>All rights</footer></body></html>"
W = {**html.DEFAULT_WEIGHTS, "p": -0.2, "/p": -0.2, "a": -0.2, "/a": -0.2, "div": -0.2, "/div": -0.2, "article": -0.2, "/article": -0.2, "li": -0.2, "/li": -0.2}


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<article><p>Hello <a href="x>world</a> again</p></article>', "Hello world again"),
        ("<article><p>One more text of words<p class=notice>Cookies<p>Two and more words of the same text</article>", "One more text of words Two and more words of the same text"),
        ('<article><div class="post-header"><h1>A title</h1></div><header>By me</header><p>Text of it</p></article>', "A title By me Text of it"),
        ('<div class="header">Site name</div><article><p>Text of it all</p></article>', "Text of it all"),
        ("<article><ul><li class=share>Share<li>Point one<li>Point two</ul></article>", "Point one Point two"),
        ("<div><p>No article here, but words enough</p></div>", "No article here, but words enough"),
        ("<article><p>2 &lt; 3 < 4</p></article>", "2 < 3 < 4"),
        ("<article><my-part><p>Own element</p></my-part></article>", "Own element"),
    ],
)
def test_extraction_of_awkward_pages(body, text):
    assert html.extract(PAGE.format(body), {**W, "header": -0.2, "/header": -0.2, "h1": -0.2, "/h1": -0.2, "ul": -0.2, "/ul": -0.2, html.OTHER: -0.2, "/" + html.OTHER: -0.2}) == text


def test_time_grows_with_the_page_alone():
    def seconds(n):
        page = "<article>" + "<div>" * n + "word " * n + "</span>" * n
        began = time.process_time()
        html.extract(page, W)
        return time.process_time() - began

    seconds(100)
    assert seconds(32_000) < 16 * max(seconds(8_000), 0.02)


def test_kinds_are_bounded(spark):
    pages = [(k, f"<html><body><nav>menu</nav><article><x-{k}><p>some words of the text {k}</p></x-{k}></article><y-{k}>outside</y-{k}></body></html>") for k in range(1500)]
    d = spark.createDataFrame(pages, "page_id long, html string")
    weights = html.learn_weights(d)
    assert len(weights) < 30 and html.OTHER in weights
    got = {r.page_id: r.text for r in html.main_text(d).collect()}
    assert all(got[k] == f"some words of the text {k}" for k in (0, 700, 1499))


def test_pages_without_an_article(spark):
    pages = [(k, f"<html><body><nav>menu</nav><main><p>some words of the text {k}</p></main><div>x</div></body></html>") for k in range(20)] + [(99, "<html><body><nav>menu</nav><p>plain words of a page</p></body></html>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got[3] == "some words of the text 3" and got[99] == "plain words of a page"


LONG = " ".join(f"word{k}" for k in range(30))
LEARNED = html.smoothed({"word": 3.0, "body": -28.0, "/body": -28.0, "html": -28.0, "/html": -28.0, "article": -28.0, "/article": -28.0, "p": -0.05, "/p": -0.05, "h1": -0.05, "/h1": -0.05, "b": -0.05, "br": -0.05, html.FURNITURE: -4.0})


@pytest.mark.parametrize("frame", ["<html><body><article>{}</article></body></html>", "<html><body><nav>Home</nav>{}<footer>About</footer></body></html>"])
@pytest.mark.parametrize(
    "inner, text",
    [
        ("<ul>" + "".join(f"<li>item{k}</li>" for k in range(40)) + "</ul>", " ".join(f"item{k}" for k in range(40))),
        ("<div></div><div></div><p>end</p>", "end"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"),
        ("<dl><dt>a</dt><dd>b</dd></dl><blockquote>c</blockquote>", "a b c"),
        ("<p>x <em>y</em> <custom-tag>z</custom-tag></p>", "x y z"),
        ("<figure><img src=a><figcaption>f</figcaption></figure>", "f"),
    ],
)
def test_no_loss_on_elements_that_labelled_pages_lack(frame, inner, text):
    page = frame.format(f"<p>{LONG}</p>{inner}<p>{LONG}</p>")
    assert html.extract(page, LEARNED) == f"{LONG} {text} {LONG}"


def test_what_follows_a_control_inside_the_article_stays():
    page = f"<article><p>{LONG}</p><p>L <label>x</label> <button>b</button> t</p></article>"
    assert html.extract(page, LEARNED) == f"{LONG} L t"
    assert html.extract(f"<p>outside {LONG}</p><article><p>in</p></article><p>{LONG}</p>", LEARNED) == "in"


def test_batches_are_bounded_and_hold_whole_texts(monkeypatch):
    """A batch ends with its epoch, at so many documents or at so many bytes; one longer text is a batch by itself."""
    import pyarrow as pa

    monkeypatch.setattr(quality, "BATCH", 3)
    monkeypatch.setattr(quality, "BATCH_BYTES", 100)
    texts = ["a" * n for n in (10, 20, 90, 5, 5, 5, 5, 500, 1)] + [None]
    rows = [(e, t, k % 2) for e in range(2) for k, t in enumerate(texts)]
    stream = [pa.RecordBatch.from_pylist([{"epoch": e, "text": t, "y": y} for e, t, y in rows[a : a + 7]], pa.schema([("epoch", pa.int32()), ("text", pa.string()), ("y", pa.int32())])) for a in range(0, len(rows), 7)]
    got = list(quality.portions(iter(stream)))
    assert [(e, len(t), y) for e, ts, ys in got for t, y in zip(ts, ys, strict=True)] == [(e, len(t or ""), y) for e, t, y in rows]
    assert all(len(ts) <= 3 and (len(ts) == 1 or sum(map(len, ts)) <= 100) for _, ts, _ in got) and [500] in [[len(t) for t in ts] for _, ts, _ in got]


def test_very_long_labelled_documents(spark):
    """Labels that only the last words of 100,000 show."""
    long = "plain words of some text " * 20_000
    docs = [(i, long + ("click here now!!! $$$ " * 4000 if i % 2 else "and so it ended well. " * 4000), i % 2) for i in range(8)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels)).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in docs)
