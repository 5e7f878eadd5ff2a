"""URL filter: path-template trees per host, rejected by smoothed labelled purity.

Level by level, the segments below a node (host and branch so far) are counted. A segment stays literal if it holds
``least_share`` of its node's pages and ``least_count`` pages, or, whatever its share, if its labels differ from its
siblings': the share of labelled pages, or the share of rejected ones among them, by a two-proportion test at
``z`` standard deviations. All other segments (numbers, ids, titles) share the wildcard ``*``. Segments that differ go
on as a branch of their own, and so do frequent ones without ``least_count`` labelled pages; frequent ones
whose labels are alike are merged into one branch. A node is not split further if it holds fewer than
``least_count`` pages or a single path; what is left of its paths is one wildcard tail. There is no limit on depth.

A branch is rejected if its purity, the share of its labelled pages that are labelled to be rejected, smoothed by
``weight`` pages at the rate ``prior``, reaches ``reject`` and at least ``least_count`` of its pages and ``least_labelled`` of
all of them are labelled; a few labels never reject the many pages beside them.

Rules (host, path, allow or block) come first where one fits; they also label the pages that the tree
learns from when no other labels are given. Everything is joins and partial aggregation; a host or branch
with a third of all pages is counted map-side, the joins to literal segments carry a salt, and the join of pages to
their paths has its skewed side split by adaptive execution. Each level is stored, so that the plan stays short.

Defined results: a null url or one without ``://`` has host and path empty and is judged as such; repeated
rows are judged each; a null page_id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage

# The rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _salted_join(pages: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table of distinct keys, a hot key's pages being dealt over ``SALTS`` tasks."""
    many = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("path", "host"), F.lit(SALTS)).cast("int")).join(many, [*keys, "_salt"], "left").drop("_salt")


def _differs(a, n, b, m, z: float) -> Column:
    """Whether the shares a / n and b / m differ by more than ``z`` standard deviations of their common rate."""
    a, n, b, m = (c.cast("double") for c in (a, n, b, m))
    rate = (a + b) / (n + m)
    return F.when((n > 0) & (m > 0), F.abs(a / n - b / m) > z * F.sqrt(rate * (1 - rate) * (1 / n + 1 / m))).otherwise(False)


def templates(paths: DataFrame, least_share: float = 0.02, least_count: int = 5, z: float = 1.96) -> DataFrame:
    """Template of every distinct (host, path) of ``paths`` (host, path, n, n_labelled, n_reject), with the branch it was merged into."""
    tree = paths.withColumn("parts", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", F.lit("")).withColumn("branch", F.lit(""))
    level, done, kinds = 0, None, ("n", "n_labelled", "n_reject")
    while True:
        tree = tree.withColumn("segment", F.get("parts", F.lit(level)))
        more = tree.where("segment is not null")
        counted = more.groupBy("host", "branch", "segment").agg(*[F.sum(c).alias(c) for c in kinds], F.count("*").alias("paths"))
        node = counted.groupBy("host", "branch").agg(*[F.sum(c).alias(f"all_{c}") for c in (*kinds, "paths")])
        node = node.where((F.col("all_n") >= least_count) & (F.col("all_paths") > 1)).drop("all_paths")
        n, k, r, others = F.col("n"), F.col("n_labelled"), F.col("n_reject"), {c: F.col(f"all_{c}") - F.col(c) for c in kinds}
        odd = _differs(k, n, others["n_labelled"], others["n"], z) | _differs(r, k, others["n_reject"], others["n_labelled"], z)
        frequent = (n >= least_share * F.col("all_n")) & (n >= least_count)
        # Few segments of a node are literal: frequent ones hold a share each, and odd ones carry labels.
        literal = counted.join(node, ["host", "branch"]).withColumn("odd", odd).where(F.col("odd") | frequent)
        literal = literal.select("host", "branch", "segment", F.lit(True).alias("literal"), (F.col("odd") | (k < least_count)).alias("own"))
        tree = _salted_join(tree, literal, ["host", "branch", "segment"]).join(node.select("host", "branch", F.lit(True).alias("open")), ["host", "branch"], "left")
        segment = F.concat(F.lit("/"), F.col("segment"))
        step = F.when(F.col("segment").isNull(), "").when(F.col("open").isNull(), "/**").when(F.col("literal"), segment).otherwise("/*")
        # Literal siblings with like labels go on as one branch; those that differ keep their own.
        own = F.when(F.col("segment").isNull(), "").when(F.col("open").isNull(), "/**").when(F.col("own"), segment).when(F.col("literal"), "/+").otherwise("/*")
        ended = F.col("segment").isNull() | F.col("open").isNull()
        tree = tree.withColumns({"template": F.concat("template", step), "branch": F.concat("branch", own), "ended": ended}).drop("literal", "own", "open", "segment")
        tree = cut_lineage(tree, "templates")
        ends = tree.where("ended").drop("ended", "parts")
        done = ends if done is None else done.unionByName(ends)
        tree, level = tree.where("not ended").drop("ended"), level + 1
        if tree.isEmpty():
            return done.select("host", "path", *kinds, "template", "branch")


def judged(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, weight: float = 4.0, prior: float = 0.25, reject: float = 0.5, least_count: int = 5, least_labelled: float = 0.1) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages`` (page_id, url).

    ``labels`` (page_id, reject 0/1) teach the tree; without them, the verdicts of the rules do.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        told = own.withColumn("reject", F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "block").cast("int")))
    else:
        told = own.join(labels.groupBy("page_id").agg(F.max("reject").alias("reject")), "page_id", "left")
    paths = told.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("reject").alias("n_labelled"), F.coalesce(F.sum("reject"), F.lit(0)).alias("n_reject"))
    tree = templates(cut_lineage(paths, "paths"), least_count=least_count)
    branches = tree.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("n_labelled").alias("k"), F.sum("n_reject").alias("r"))
    purity = (F.col("r") + weight * prior) / (F.col("k") + weight)
    told_of = (purity >= reject) & (F.col("k") >= least_count) & (F.col("k") >= least_labelled * F.col("n"))
    of_path = _salted_join(tree.select("host", "path", "template", "branch"), branches.select("host", "branch", purity.alias("purity"), told_of.alias("rejected")), ["host", "branch"])
    out = own.join(of_path, ["host", "path"], "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
