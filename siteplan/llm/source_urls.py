"""Verdicts on source URLs: host and path rules first, then a tree of path templates with labelled purity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (up to ``?`` or ``#``).

    Null URLs and URLs without ``://`` have both empty.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. ``rules``: verdict and ``host/path`` of each.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def judge_sources(
    sources: DataFrame, rules: list[tuple[str, str]], bands: int = 5, alpha: float = 0.05, weight: float = 5.0, reject_at: float = 0.7
) -> DataFrame:
    """Judge the URL of every source snapshot (``artifact_id, url``): allow or block.

    Returns ``artifact_id, host, path, rule, verdict, template, purity``. Where a rule fits, its verdict stands; those
    sources are also the labels. The others get the verdict of their template:

    * Segments with digits are generalised at once (runs of digits become ``<n>``). The evidence of a path is its
      host's labels or, where it has none, those of the same path on all hosts.
    * From the root of a host down, a node is split by its next segment while that can tell anything: not where no path
      below has evidence, where one path is left, or where all paths have evidence of one verdict. What lies below
      such a node is ``**``. No depth and no number of children changes this.
    * Children without evidence are a variable field and become ``*``. Children with evidence whose smoothed block rates
      lie in the same of ``bands`` equal bands are alike, so any two of them are; those whose own rate does not
      differ from the rate of their band by Hoeffding's bound at ``alpha`` are merged into one branch, named by its
      first and last segment. The others keep their names.
    * A template's purity is its block rate, smoothed with ``weight`` labels at the rate of its paths on all hosts,
      itself smoothed with the overall rate. Templates at ``reject_at`` or above are blocked. A template whose paths
      have no label on any host has a null purity and is not blocked.

    Rows are first added up per host and generalised path, and branches by hash aggregation, so neither a hot host nor a
    node with many children is held in one task. There are as many rounds as the longest path that is still to be split.
    Null ids and repeated rows keep their rows; null URLs have empty host and path and the template ``/``; empty input
    gives no rows; other columns are not read.
    """
    host, path = host_and_path("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = sources.select("artifact_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("_said"))
    judged = judged.select("*", F.array_remove(F.split(F.regexp_replace("path", "[0-9]+", "<n>"), "/"), "").alias("_parts"))
    labels = [F.count("_said").alias("_labels"), F.count(F.when(F.col("_said") == "block", 1)).alias("_blocked")]
    paths = stage(judged.groupBy("host", "_parts").agg(*labels), "url-paths")
    alike = paths.groupBy("_parts").agg(F.sum("_labels").alias("_all"), F.sum("_blocked").alias("_all_blocked"))
    overall = paths.agg(F.sum("_labels").alias("n"), F.sum("_blocked").alias("b")).first()
    prior = ((overall["b"] or 0) + 1) / ((overall["n"] or 0) + 2)
    own = F.col("_labels") > 0
    evidence = [F.when(own, F.col("_labels")).otherwise(F.col("_all")).alias("_n"), F.when(own, F.col("_blocked")).otherwise(F.col("_all_blocked")).alias("_b")]
    tree = stage(paths.join(alike, "_parts").select("*", *evidence, F.lit("").alias("_prefix")), "url-evidence")
    sums = [F.sum("_n").alias("_n"), F.sum("_b").alias("_b")]
    done, level = [], 0
    while True:
        known = F.count(F.when(F.col("_n") > 0, 1))
        mixed = (F.count(F.lit(1)) > 1) & (F.sum("_n") > 0) & ((known < F.count(F.lit(1))) | ((F.sum("_b") > 0) & (F.sum("_b") < F.sum("_n"))))
        nodes = tree.groupBy("host", "_prefix").agg(mixed.alias("_mixed"))
        tree = stage(tree.join(nodes, ["host", "_prefix"]).withColumn("_part", F.when(F.col("_mixed"), F.get("_parts", F.lit(level)))), f"url-nodes-{level}")
        below = F.when(~F.col("_mixed") & (F.size("_parts") > level), F.lit("/**")).otherwise(F.lit(""))
        ended = F.concat("_prefix", below)
        done.append(tree.where(F.col("_part").isNull()).select("host", "_parts", "_labels", "_blocked", "_all", "_all_blocked", F.when(ended == "", F.lit("/")).otherwise(ended).alias("template")))
        tree = tree.where(F.col("_part").isNotNull()).drop("_mixed")
        if tree.isEmpty():
            break
        node = ["host", "_prefix"]
        branches = tree.groupBy(*node, "_part").agg(*sums)
        smoothed = (F.col("_b") + weight * prior) / (F.col("_n") + weight)
        branches = branches.select("*", F.when(F.col("_n") > 0, F.least(F.floor(smoothed * bands), F.lit(bands - 1))).alias("_band"))
        fields = branches.where(F.col("_band").isNull()).select(*node, "_part", F.lit("*").alias("_name"))
        totals = branches.where(F.col("_band").isNotNull()).groupBy(*node, "_band").agg(F.sum("_n").alias("_band_n"), F.sum("_b").alias("_band_b"))
        near = F.abs(F.col("_b") / F.col("_n") - F.col("_band_b") / F.col("_band_n")) <= F.sqrt(F.lit(math.log(2 / alpha)) / (F.col("_n") * 2))
        placed = branches.join(totals, [*node, "_band"]).select(*node, "_part", "_band", near.alias("_near"))
        ends = [F.min("_part").alias("_first"), F.max("_part").alias("_last"), F.count(F.lit(1)).alias("_members")]
        merged = placed.where("_near").groupBy(*node, "_band").agg(*ends).where(F.col("_members") > 1).withColumn("_near", F.lit(True))
        span = F.concat(F.lit("{"), F.col("_first"), F.when(F.col("_members") > 2, F.lit("|..|")).otherwise(F.lit("|")), F.col("_last"), F.lit("}"))
        named = placed.join(merged, [*node, "_band", "_near"], "left").select(*node, "_part", F.coalesce(span, F.col("_part")).alias("_name"))
        tree = tree.join(fields.unionByName(named), [*node, "_part"]).withColumn("_prefix", F.concat("_prefix", F.lit("/"), F.col("_name"))).drop("_part", "_name")
        tree, level = stage(tree, f"url-level-{level + 1}"), level + 1
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    totals = [F.sum(c).alias(c) for c in ("_labels", "_blocked", "_all", "_all_blocked")]
    templates = ended.groupBy("host", "template").agg(*totals)
    base = (F.col("_all_blocked") + weight * prior) / (F.col("_all") + weight)
    purity = F.when(F.col("_all") > 0, (F.col("_blocked") + weight * base) / (F.col("_labels") + weight))
    known = ended.join(templates.select("host", "template", purity.alias("purity")), ["host", "template"]).select("host", "_parts", "template", "purity")
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(known, ["host", "_parts"]).select("artifact_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), "template", "purity")
