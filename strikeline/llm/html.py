"""Main text of web pages as the maximum-scoring run of tokens.

A page is cut into tokens: tags (name, closing or not, with class or id words that name furniture), and words. Words score positive and tags
negative; every kind's weight is its log-odds of standing inside rather than outside the content of labelled pages. A linear scan finds the
contiguous run of the largest sum. An element of furniture (forms, navigation, asides, comment lists, ...) counts once, as one negative token, and
is left out of the text of a run that spans it.

A page labels itself where it has exactly one <article> (or, lacking that, one <main>) element; the weights are counted over all such pages. In such a page
the mark bounds the run: tags inside it cost nothing, and what is outside counts against the run. Kinds that no labelled page has get the mean weight of
the seen ones of their class (elements inside a block, and blocks).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.vectors import chunks, short_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "cookie", "cookies", "consent", "disclaimer", "disqus",
    "footer", "header", "hidden", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies",
    "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "contentinfo", "complementary", "search",
))
#: Elements that are never content, elements without an end tag, elements inside a block.
FURNITURE_TAGS = frozenset(("nav", "footer", "aside", "form", "head", "header", "title", "button", "menu", "dialog", "label", "input", "option", "fieldset", "legend"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
))
#: An open element of the value ends where the key begins; an open <p> where one of ENDS_P does.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
ENDS_P = frozenset((
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
))
#: Elements that have a weight of their own; all others are counted together.
ELEMENTS = INLINE | VOID | ENDS_P | FURNITURE_TAGS | frozenset((
    "body", "caption", "center", "colgroup", "dd", "details", "dt", "figcaption", "figure", "hgroup", "html", "li", "optgroup", "output", "picture", "progress", "rp", "rt", "ruby", "summary", "tbody",
    "td", "tfoot", "th", "thead", "tr", "audio", "video", "canvas", "map", "meter",
))
OTHER = "other"

TEXT, TAG = 1, 2
#: Kinds of a whole element of furniture, which counts once, and of the tags in it, which do not count.
FURNITURE, NESTED = "furniture", ""


def _marks(attrs: str) -> set[str]:
    """Words in class, id and role."""
    found = " ".join(x for g in MARK.findall(attrs) for x in g)
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found).lower())) if found else set()


def tokenize(page: str) -> Iterator[tuple]:
    """(TEXT, characters) and (TAG, name, closing, furniture words); scripts, styles, comments and declarations are one tag each, of a name that begins
    with <!. A tag whose quote is never closed ends at its first >."""
    for m in TOKEN.finditer(page):
        s = m.group()
        name = m.group(3) or m.group(6)
        if s[0] != "<" or s == "<":
            yield TEXT, s
        elif name:
            name, closing, attrs = name.lower(), bool(m.group(2) or m.group(5)), m.group(4) or m.group(7)
            words = FURNITURE_WORDS & _marks(attrs) if attrs and not closing else set()
            yield TAG, name, closing, words | {name} if name in FURNITURE_TAGS else words
        else:
            yield TAG, "<!" + (m.group(1) or "").lower(), True, set()


class _Open:
    """The open elements, and how many of each there are."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.count: Counter = Counter()
        self.depth = 0  # of furniture

    def push(self, name: str) -> None:
        self.stack.append(name)
        self.count[name] += 1
        self.depth += name.endswith("!")

    def pop(self) -> str:
        top = self.stack.pop()
        self.count[top] -= 1
        self.depth -= top.endswith("!")
        return top

    def close(self, name: str) -> None:
        """The innermost element of the name ends, and all in it; content before furniture."""
        for own in (name, name + "!"):
            if self.count[own]:
                while self.pop() != own:
                    pass
                return

    def end_implied(self, name: str) -> None:
        """Ends an open <p>, list item or cell that the beginning element cannot stand in."""
        ends = ("p",) if name in ENDS_P else ENDS.get(name, ())
        while self.stack and self.stack[-1].rstrip("!") in ends:
            self.pop()


def _tokens(page: str) -> list[tuple]:
    """(TEXT, characters, in furniture, in article, in main) and (TAG, kind, name, in furniture, in article, in main)."""
    out: list[tuple] = []
    at = _Open()
    for t in tokenize(page):
        where = (at.count["article"] > 0, at.count["main"] > 0)
        if t[0] == TEXT:
            out.append((*t, at.depth > 0, *where))
            continue
        _, name, closing, words = t
        kind = name if name[0] == "<" or name in ELEMENTS else OTHER
        if closing:
            inside = at.depth > 0
            at.close(name)
            out.append((TAG, NESTED if inside else name if name[0] == "<" else "/" + kind, name, inside, at.count["article"] > 0, at.count["main"] > 0))
            continue
        at.end_implied(name)
        where = (at.count["article"] > 0, at.count["main"] > 0)
        # headings of the article itself stay, whether a <header> or an element whose class says so
        if where[0] and not at.depth:
            words = words - {"header"}
        furniture = bool(words) and name not in ("article", "main", "body", "html")
        out.append((TAG, NESTED if at.depth else FURNITURE if furniture else kind, name, at.depth > 0 or furniture, *where))
        if name not in VOID:
            at.push(name + "!" if furniture else name)
    return out


def _kinds(token: tuple) -> tuple[str, int]:
    """The kind that has a weight, and how often it counts."""
    if token[0] == TEXT:
        return "word", 0 if token[2] else len(token[1].split())
    return token[1], int(token[1] != NESTED)


def count_kinds(page: str | None) -> Counter:
    """(kind, inside content) counts of a page that labels itself, else nothing."""
    tokens = _tokens(page or "")
    opened = Counter(t[1] for t in tokens if t[0] == TAG)  # kinds of end tags begin with /
    at = 4 if opened["article"] == 1 else 5 if not opened["article"] and opened["main"] == 1 else 0
    counts: Counter = Counter()
    if at:
        for t in tokens:
            inside = t[at - 1] if t[0] == TEXT else t[at]
            kind, n = _kinds(t)
            counts[kind, inside] += n
    return counts


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each kind, from all pages that label themselves. The driver gets two numbers per kind; there is one for each end of an element of
    ELEMENTS and one for all others together, so these are some hundred whatever the pages hold."""
    short_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_kinds(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    found = pages.select(F.col(html_col).alias("html")).mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")
    )
    rows = found.collect()
    inside, outside = sum(r.a for r in rows if not r.kind.startswith("word")), sum(r.b for r in rows if not r.kind.startswith("word"))
    weights = {}
    for r in rows:
        if not r.kind.startswith("word"):
            odds = math.log(((r.a + 0.5) / (inside + 1)) / ((r.b + 0.5) / (outside + 1)))
            weights[r.kind] = -min(4.0 if r.kind == FURNITURE or r.kind.startswith("<!") else 30.0, max(0.05, 1.0 - odds * 3))
    words = next(((r.a + 0.5, r.b + 0.5) for r in rows if r.kind == "word"), (1.0, 1.0))
    weights["word"] = max(0.5, min(3.0, math.log(words[0] / words[1])))
    return weights


DEFAULT_WEIGHTS = {"word": 1.0, FURNITURE: -4.0}
#: Weight of a kind where no page labels itself; and of everything outside of the mark of a page that does.
UNKNOWN, OUTSIDE = -0.3, -30.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of the largest sum, in one scan; of runs of one sum the one that ends first, and no run where no sum is above 0."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, best_at = total, (begin, i + 1)
    return best_at


def _is_inline(kind: str) -> bool:
    return kind.strip("/") in INLINE


def smoothed(weights: dict[str, float]) -> dict[str, float]:
    """Weights of all kinds: one that was not seen gets the mean of the seen ones of its class that are no page frame (those weigh far below all others)."""
    seen = {k: w for k, w in weights.items() if k not in ("word", FURNITURE, NESTED) and k[0] != "<" and w > -UNSEEN_FRAME}
    out = dict(weights)
    for inline in (True, False):
        own = [w for k, w in seen.items() if _is_inline(k) == inline] or list(seen.values()) or [UNKNOWN]
        mean = sum(own) / len(own)
        for name in (*ELEMENTS, OTHER):
            for kind in (name, "/" + name):
                if _is_inline(kind) == inline:
                    out.setdefault(kind, mean)
    return out


#: A tag that weighs less stands around content, not in it.
UNSEEN_FRAME = 3.0


def scored(tokens: list[tuple], weights: dict[str, float]) -> list[float]:
    """The score of each token; in a page that labels itself, by its own mark."""
    opened = Counter(t[1] for t in tokens if t[0] == TAG)
    at = 4 if opened["article"] == 1 else 5 if not opened["article"] and opened["main"] == 1 else 0
    if not at:
        return [weights.get(kind, UNKNOWN) * n for kind, n in map(_kinds, tokens)]
    out = []
    for t in tokens:
        kind, n = _kinds(t)
        inside = t[at - 1] if t[0] == TEXT else t[at]
        out.append((weights["word"] * n if kind == "word" else 0.0) if inside else OUTSIDE * n)
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best run: blocks in page order, white space within them as one space, joined by one space."""
    tokens = _tokens(page or "")
    parts: list[str] = []
    for t in tokens[slice(*best_run(scored(tokens, weights)))]:
        if t[0] == TEXT:
            if not t[2]:
                parts.append(entities.unescape(t[1]))
        elif t[2] not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, html_col: str = "html") -> DataFrame:
    """All columns of pages and `text`, `n_chars`.

    Null or empty pages, and pages without words, have an empty text. Repeated rows are each answered, cut-off pages are read to their end, and
    columns named text or n_chars are replaced. Of two runs of one sum the first counts.
    """
    short_batches(pages.sparkSession)
    own = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c not in ("text", "n_chars")])
    found = smoothed({**DEFAULT_WEIGHTS, **(learn_weights(pages, html_col) if weights is None else weights)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html_col):
            texts = [extract(x, found) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add("text", "string").add("n_chars", "long"))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
