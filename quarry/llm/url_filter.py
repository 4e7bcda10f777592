"""URL filters by rules and a path-template tree.

Rules come first: the longest that fits decides. What no rule fits is judged by a tree
of path templates for each host, learned from the urls that are labelled (by default
those that a rule fits):

1. Digits and long hexadecimal runs of a path become ``{n}`` and ``{h}``; equal shapes of a
   host are counted together, in the map tasks first, so a host with a third of all
   rows is as small as its number of shapes.
2. From the root down, the children of a node are looked at together. Where a node has more
   than ``MAX_CHILDREN``, those with less than ``MIN_SHARE`` of its urls are variable and
   become the wildcard ``*``. Of the labelled children, neighbours in order of their share of good labels merge if a z-test of two proportions can't
   tell them apart; a branch of several is named ``{0}``, ``{1}`` and so on, from the worst. Unlabelled children can't be told from
   each other and are one branch, ``{?}``.
3. A template's purity is (good + PRIOR * purity of its parent) / (good + bad + PRIOR), and one half above the root of a host. So a thin branch
   mostly has the purity of the one it belongs to, and an unlabelled one has just that. Templates below ``REJECT`` are blocked.

Every step is a grouped count or a join, the merge a window over the children that a node has left, at most a hundred or so; a level's table is written to the shared folder.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import release, stored

MAX_CHILDREN, MIN_SHARE = 50, 0.02
DEPTH = 5
#: With this prior one bad url does not reject its host or template; two without a good one do.
Z, PRIOR, REJECT = 1.96, 4.0, 0.35
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape_of(path: Column) -> Column:
    """The path with long hexadecimal runs and digits generalised."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])", "{h}"), r"[0-9]+", "{n}")


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null; the last of equal length in order of the rule's text.

    Rules are a constant of the plan, found by each suffix of the host, so a url costs as much as its host has labels.
    """
    by_host = defaultdict(list)
    for verdict, h, p in rules:
        by_host[h].append({"path": p, "length": len(h + p), "rule": h + p, "verdict": verdict})
    kind = "array<struct<path:string,length:int,rule:string,verdict:string>>"
    table = F.from_json(F.lit(json.dumps(by_host)), f"map<string,{kind}>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array().cast(kind))))
    fits = F.filter(found, lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _purity(good: Column, bad: Column, parent: Column) -> Column:
    return (good + PRIOR * parent) / (good + bad + PRIOR)


def _merged(groups: DataFrame) -> DataFrame:
    """(node, first, name) of ``groups(node, first, good, bad)``: the branch that each child belongs to."""
    known = F.col("good") + F.col("bad")
    order = Window.partitionBy("node").orderBy(F.col("good") / known, "first")
    before = [F.lag(c).over(order) for c in ("good", "known")]
    found = groups.where(known > 0).withColumn("known", known).withColumn("was", before[0]).withColumn("of", before[1])
    both = (F.col("good") + F.col("was")) / (F.col("known") + F.col("of"))
    error = F.sqrt(both * (1 - both) * (1 / F.col("known") + 1 / F.col("of")))
    apart = F.coalesce((error > 0) & (F.col("good") / F.col("known") - F.col("was") / F.col("of") > Z * error), F.lit(False))
    branch = F.sum(apart.cast("int")).over(order)
    found = found.withColumn("branch", branch).withColumn("size", F.count("*").over(Window.partitionBy("node", "branch")))
    named = found.select("node", "first", F.when(F.col("size") > 1, F.concat(F.lit("{"), F.col("branch").cast("string"), F.lit("}"))).otherwise(F.col("first")).alias("name"))
    return named.unionByName(groups.where(known == 0).select("node", "first", F.lit("{?}").alias("name")))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of ``shapes(host, shape, n, good, bad)``: the tree's leaf for each shape.

    Segments beyond ``DEPTH`` are one tail.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    roots = shapes.groupBy("host").agg(*sums).select("host", _purity(F.col("good"), F.col("bad"), F.lit(0.5)).alias("purity"))
    now = level = stored(shapes.join(roots, "host").withColumn("parts", F.split("shape", "/", DEPTH + 2)).withColumn("node", F.col("host")), "url-level")
    for d in range(1, DEPTH + 2):
        # Shapes that ended above stay at their node, as a child without a name.
        now = now.withColumn("child", F.get("parts", F.lit(d)))
        kids = now.where("child is not null").groupBy("node", "child").agg(*sums, F.first("purity").alias("parent"))
        whole = kids.groupBy("node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
        variable = (F.col("kinds") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all"))
        seen = stored(kids.join(whole, "node").withColumn("first", F.when(variable, F.lit("*")).otherwise(F.col("child"))), "url-children")
        groups = seen.groupBy("node", "first").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        named = seen.join(_merged(groups), ["node", "first"])
        pure = named.groupBy("node", "name").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("parent").alias("parent"))
        pure = pure.select("node", "name", _purity(F.col("good"), F.col("bad"), F.col("parent")).alias("own"))
        moves = named.select("node", "child", "name").join(pure, ["node", "name"])
        step = F.when(F.col("name").isNull(), F.col("node")).otherwise(F.concat_ws("/", "node", "name"))
        joined = now.join(moves, ["node", "child"], "left")
        later = stored(joined.select("host", "shape", "n", "good", "bad", "parts", step.alias("node"), F.coalesce("own", "purity").alias("purity")), "url-level")
        release(level, seen)
        now = level = later
    return now.select("host", "shape", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``rules`` are (verdict, host, path) with verdicts allow and block; a rule fits its host and all subdomains where the
    path starts with the rule's. ``label_col`` names a column of true, false or null that
    labels urls as good; without it the urls that a rule fits are labelled by it. A null url, or one without ``://``,
    has an empty host and path, like any other host's; urls of any length are read whole. Repeated rows count each and are judged alike; null ids pass through,
    other columns are not read. An empty table gives no rows.
    """
    url = F.col(f"`{url_col}`").cast("string")
    good = F.col(f"`{label_col}`").cast("boolean") if label_col else F.lit(None).cast("boolean")
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), good.alias("good"))
    parsed = parsed.withColumn("fit", ruled(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    if not label_col:
        parsed = parsed.withColumn("good", F.col("fit.verdict") == "allow")
    # Read twice; and a filter on the result must not reach into the expressions of rules and shapes.
    parsed = stored(parsed, "url-parsed")
    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = stored(shapes, "url-shapes")
    tree = templates(counted)
    release(counted)
    found = parsed.select("page_id", "host", "path", "shape", "fit").join(tree, ["host", "shape"])
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") < REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
