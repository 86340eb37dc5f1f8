"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

A tree stands for a host; a second one, of the same make, pools all hosts. A branch's pages are told apart by their next path segment. A segment stays as it is
where it is frequent in its branch (SUPPORT pages and a SHARE of them), else it is a variable one and becomes a wildcard of its shape, so a branch
has at most 1 / SHARE literals and a wildcard for each shape. Branches side by side whose shares of blocked pages do not differ (likelihood ratio
below SAME) are merged, and what is below them is one from there on. So all counts are sums by branch and name, and a level of the tree has a few rows for
each host, whatever the number of pages.

A template's purity is the share of blocked pages among its labelled ones, smoothed: with WEIGHT pages of its parent's purity in the pooled tree, and with WEIGHT
pages of the page's pooled purity in the tree of the host. Pages whose template has a purity of REJECT or more are blocked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm.vectors import shared_table

#: verdict, host, beginning of the path.
Rule = tuple[str, str, str]
#: Path segments that are levels of the tree; the last one holds all that follows.
DEPTH = 4
SUPPORT, SHARE = 8, 1 / 16
#: 99.9 % of the chi-square distribution of one degree.
SAME = 10.83
WEIGHT, REJECT = 8.0, 0.5
#: A hot host's pages meet its branches in so many parts.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null and without `://`; only A-Z of the host are lower-cased."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one. A rule fits its host and all subdomains, where the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """The wildcard of a segment: what its body is made of, and whether it ends in an extension."""
    has_end = segment.rlike(r"(?s)^.+\.[A-Za-z]\w{0,4}\z")
    body = F.when(has_end, F.regexp_replace(segment, r"\.[A-Za-z]\w{0,4}\z", "")).otherwise(segment)
    kind = (
        F.when(segment.isNull(), F.lit(None).cast("string")).when(segment == "", "<>").when(segment.contains("/"), "<rest>").when(body.rlike(r"^[0-9]+\z"), "<number>")
        .when(body.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}\z"), "<hex>").when(body.rlike("[0-9]"), "<mixed>").otherwise("<word>")
    )
    return F.concat(kind, F.when(has_end, ".x").otherwise(""))


def literal(segment: Column) -> Column:
    """The segment as a name that is no wildcard and no merged name."""
    for c, escaped in (("%", "%25"), ("<", "%3C"), ("{", "%7B"), ("|", "%7C")):
        segment = F.replace(segment, F.lit(c), F.lit(escaped))
    return segment


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def _likelihood(a: Column, b: Column) -> Column:
    return _x_log_x(a) + _x_log_x(b) - _x_log_x(a + b)


def likelihood_ratio(x: Column, y: Column) -> Column:
    """How much better two shares tell the labels of x and y than one share of both does; x and y have a (allowed) and b (blocked)."""
    return 2.0 * (_likelihood(x["a"], x["b"]) + _likelihood(y["a"], y["b"]) - _likelihood(x["a"] + y["a"], x["b"] + y["b"]))


def merge_similar(children: Column) -> Column:
    """Groups of children (name, n, a, b) by share of blocked pages, each as long as the next child is like the whole group; unlabelled ones stay alone."""
    group = lambda c: F.struct(F.array(c["name"]).alias("names"), c["n"].alias("n"), c["a"].alias("a"), c["b"].alias("b"))
    share = lambda c: F.struct((c["b"] / (c["a"] + c["b"])).alias("share"), *(c[k].alias(k) for k in ("name", "n", "a", "b")))
    labelled = F.array_sort(F.transform(F.filter(children, lambda c: c["a"] + c["b"] > 0), share))
    bare = F.transform(F.array_sort(F.filter(children, lambda c: c["a"] + c["b"] == 0)), group)

    def add(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        both = F.struct(F.concat(last["names"], F.array(c["name"])).alias("names"), *((last[k] + c[k]).alias(k) for k in ("n", "a", "b")))
        like = likelihood_ratio(last, c) < SAME
        return F.when((F.size(acc) > 0) & like, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(group(c))))

    empty = F.lit(None).cast("array<struct<names:array<string>,n:double,a:double,b:double>>")
    return F.concat(F.aggregate(labelled, F.coalesce(empty, F.slice(bare, 1, 0)), add), bare)


def grow(rows: DataFrame, trees: dict[str, str]) -> DataFrame:
    """rows (key columns, `_segments`, `_blocked` 1, 0 or null, `_salt`) with {tree}_template, {tree}_purity, and the template's labelled pages {tree}_a and
    {tree}_b. trees: the key column of each tree. All trees grow by a level at a time; their models are one small table."""
    a, b = F.count_if(F.col("_blocked") == 0).cast("double").alias("a"), F.count_if(F.col("_blocked") == 1).cast("double").alias("b")
    count = F.count("*").cast("double").alias("n")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")

    def of_trees(*parts: Callable[[str], Column]) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(t).alias("_tree"), F.col(k).alias("_key"), *(p(t) for p in parts)) for t, k in trees.items()))).alias("_t")

    def attached(now: DataFrame, model: DataFrame, *, level: bool) -> DataFrame:
        for t, k in trees.items():
            on = {"_key": k, "_branch": f"{t}_branch"} if level else {"_key": k}
            small = model.where(F.col("_tree") == t).drop("_tree").withColumnsRenamed({c: f"_of_{c}" for c in on}).select("*", salts)
            small = small.withColumnsRenamed({c: f"{t}_{c}" for c in ("n", "a", "b", "p", "children") if c in small.columns} | {"_salt": "_part"})
            test = F.col("_salt") == F.col("_part")
            for c, own in on.items():
                test = test & (F.col(own) == F.col(f"_of_{c}"))
            now = now.join(small, test, "left").drop("_part", *(f"_of_{c}" for c in on))
        return now

    root = rows.select("_blocked", "_segments", of_trees()).groupBy("_t._tree", "_t._key").agg(count, a, b, F.max(F.size("_segments")).alias("depth")).withColumn("p", (F.col("b") + 1.0) / (F.col("a") + F.col("b") + 2.0))
    root = shared_table(root)
    now = attached(rows, root.drop("depth"), level=False).withColumns({f"{t}_branch": F.lit("") for t in trees})
    for level in range(root.agg(F.max("depth")).first()[0] or 0):
        segment = F.get("_segments", F.lit(level))
        now = now.withColumns({"_literal": literal(segment), "_shape": shape(segment)})
        # each page counts for its segment and for its shape; a segment that is frequent is taken off its shape
        branches = now.where(segment.isNotNull()).select("_blocked", "_literal", "_shape", of_trees(lambda t: F.col(f"{t}_branch").alias("_branch"), lambda t: F.col(f"{t}_n").alias("n"), lambda t: F.col(f"{t}_p").alias("p")))
        named = branches.select("_t.*", "_blocked", F.col("_shape").alias("shape"), F.explode(F.array("_literal", "_shape")).alias("name"))
        counts = named.groupBy("_tree", "_key", "_branch", "name", "shape").agg(count, a, b, F.max("n").alias("of"), F.max("p").alias("p"))
        frequent = counts.where((F.col("name") == F.col("shape")) | ((F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("of"))))
        found = frequent.groupBy("_tree", "_key", "_branch").agg(F.max("p").alias("p"), F.collect_list(F.struct("name", "shape", "n", "a", "b")).alias("all"))
        own = lambda c, k: c[k] - F.aggregate(F.filter("all", lambda x: (c["name"] == c["shape"]) & (x["name"] != x["shape"]) & (x["shape"] == c["shape"])), F.lit(0.0), lambda s, x: s + x[k])
        rest = F.transform("all", lambda c: F.struct(c["name"].alias("name"), *(own(c, k).alias(k) for k in ("n", "a", "b"))))
        groups = merge_similar(F.filter(rest, lambda c: c["n"] > 0))
        branch = lambda g: F.concat(F.col("_branch"), F.lit("/"), F.when(F.size(g["names"]) == 1, g["names"][0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort(g["names"]), "|"), F.lit("}"))))
        smooth = lambda g: (g["b"] + WEIGHT * F.col("p")) / (g["a"] + g["b"] + WEIGHT)
        children = F.transform(groups, lambda g: F.struct(g["names"].alias("names"), branch(g).alias("branch"), g["n"].alias("n"), g["a"].alias("a"), g["b"].alias("b"), smooth(g).alias("p")))
        now = attached(now, shared_table(found.select("_tree", "_key", "_branch", children.alias("children"))), level=True)
        for t in trees:
            having = lambda c, t=t: F.get(F.filter(f"{t}_children", lambda g: F.array_contains(g["names"], F.col(c))), F.lit(0))
            now = now.withColumn("_child", F.when(F.col("_shape").isNotNull(), F.coalesce(having("_literal"), having("_shape")))).drop(f"{t}_children")
            now = now.withColumns({f"{t}_{c}": F.coalesce(F.col("_child")[c], F.col(f"{t}_{c}")) for c in ("branch", "n", "a", "b", "p")})
    names = {f"{t}_{c}": f"{t}_{d}" for t in trees for c, d in (("branch", "template"), ("p", "purity"))}
    return now.withColumnsRenamed(names).drop("_child", "_literal", "_shape", *(f"{t}_n" for t in trees))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], key_col: str = "page_id", url_col: str = "url", blocked: Column | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, template, purity, pooled_template, pooled_purity.

    Labels are what rules decide, or `blocked` (a condition on the columns of pages, null where unknown). A null URL or one without `://` has an empty host and path and
    is a page of the host of that name; repeated rows count each; the key is not looked at, other columns are not read. Without any
    label all purities are one half and all pages without a rule are blocked; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key_col).alias("page_id"), host.alias("host"), path.alias("path"), *([] if blocked is None else [blocked.cast("int").alias("_given")]))
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    label = F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0) if blocked is None else F.col("_given")
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH))
    rows = rows.withColumns({"_blocked": label, "_segments": segments, "_salt": F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"), "_all": F.lit("")})
    out = grow(rows, {"pooled": "_all", "host": "host"})
    purity = (F.col("host_b") + WEIGHT * F.col("pooled_purity")) / (F.col("host_a") + F.col("host_b") + WEIGHT)
    judged = out.withColumn("purity", purity)
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        F.col("host_template").alias("template"), "purity", "pooled_template", "pooled_purity",
    )


RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by RULES, and by the templates that they label."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
