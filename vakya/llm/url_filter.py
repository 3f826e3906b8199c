"""URL filters by a path-template tree, with DataFrame functions only.

Each host has a tree of path segments, built level by level from the host down. Variable segments become wildcards: runs
of digits by their form, and the segments of a branch point whose labelled shares of bad pages don't differ significantly
from those of its other branches, or which have too few labels to tell; these are merged into one branch, and so are
the trees below them. A template is rejected if its smoothed labelled share of bad pages is well above that of all pages.
Listed rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, written

#: Rows up to which the tree is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 400_000

# Fixed values: (action, host, path) of the listed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class TreeLimits:
    """Parameters of the tree; none of them leaves out rows."""

    #: Segments of a path that are levels of the tree; what is below is one last segment.
    levels: int = 8
    #: Squared normal deviate: branches that differ less from their siblings are merged.
    similar: float = 3.84
    #: Branches with fewer labelled pages are merged.
    least_labels: int = 5
    #: Weight of the global share of bad pages in the smoothed share.
    prior_weight: float = 8.0
    #: A template is rejected from this multiple of the global share of bad pages on.
    reject_from: float = 1.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty if it is null or has no ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest listed rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def segments(path: Column, levels: int) -> Column:
    """The segments of a path that aren't empty, with runs of digits as ``#``; what is below ``levels`` is one segment."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    return F.when(F.size(parts) <= levels, parts).otherwise(F.concat(F.slice(parts, 1, levels - 1), F.array(F.array_join(F.slice(parts, levels, F.size(parts)), "/"))))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limits: TreeLimits = TreeLimits()) -> DataFrame:
    """One row for each row of ``pages(page_id, url)``: host, path, rule, verdict and the template that decided.

    ``labels(page_id, bad)`` marks some pages as bad (1) or not (0); several labels of one page count as one, bad if
    any is. Pages whose template has no label get the global share alone, so they are allowed.
    A null URL has an empty host and path; repeated rows each get a row, and count once in the tree; an empty table
    gives an empty result.
    """
    host, path = url_parts(F.col("__url"))
    base = pages.select(F.col("page_id"), F.col("url").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), segments(F.col("path"), limits.levels).alias("segs"))
    marked = labels.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    seen = base.select("page_id", "host", "segs").distinct().join(marked, "page_id", "left")
    leaves = seen.groupBy("host", "segs").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    tree = written(template_tree(written(leaves), limits))
    verdict = F.coalesce(F.col("action"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return base.join(broadcast_if_small(tree, BROADCAST_ROWS), ["host", "segs"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "n_labelled", "n_bad")


def template_tree(leaves: DataFrame, limits: TreeLimits) -> DataFrame:
    """For each leaf (host, segs) with n labelled pages, b of them bad: its template and whether that is rejected."""
    depth, all_n, all_b = leaves.agg(F.max(F.size("segs")), F.sum("n"), F.sum("b")).first()
    nodes = leaves.withColumn("template", F.col("host"))
    for k in range(1, (depth or 0) + 1):
        here = nodes.where(F.size("segs") >= k).withColumn("seg", F.element_at("segs", k))
        children = here.groupBy("template", "seg").agg(F.sum("n").alias("child_n"), F.sum("b").alias("child_b"))
        parents = children.groupBy("template").agg(F.sum("child_n").alias("all_n"), F.sum("child_b").alias("all_b"))
        name = F.when(_similar(limits), F.lit("*")).otherwise(F.col("seg"))
        named = children.join(parents, "template").select("template", "seg", F.concat("template", F.lit("/"), name).alias("longer"))
        taken = here.join(broadcast_if_small(written(named), BROADCAST_ROWS), ["template", "seg"]).select("host", "segs", "n", "b", F.col("longer").alias("template"))
        nodes = written(nodes.where(F.size("segs") < k).unionByName(taken))
    prior = (all_b or 0) / max(all_n or 0, 1)
    share = (F.col("n_bad").cast("double") + F.lit(prior) * F.lit(limits.prior_weight)) / (F.col("n_labelled").cast("double") + F.lit(limits.prior_weight))
    judged = nodes.groupBy("template").agg(F.sum("n").alias("n_labelled"), F.sum("b").alias("n_bad"))
    judged = judged.withColumn("rejected", (F.col("n_bad") > 0) & (share >= F.lit(limits.reject_from) * F.lit(prior)))
    return nodes.join(broadcast_if_small(written(judged), BROADCAST_ROWS), "template").select("host", "segs", "template", "n_labelled", "n_bad", "rejected")


def _similar(limits: TreeLimits) -> Column:
    """Whether child_b of child_n differs from what its siblings have by less than the deviate allows, or has too few labels (products only, so exact in any engine)."""
    n, b, all_n, all_b = (F.col(x).cast("double") for x in ("child_n", "child_b", "all_n", "all_b"))
    gap = b * all_n - n * all_b
    return (n < F.lit(float(limits.least_labels))) | (n == all_n) | (gap * gap * all_n <= F.lit(limits.similar) * n * (all_n - n) * all_b * (all_n - all_b))
