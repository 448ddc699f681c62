"""Provenance: reachable artifacts, inherited privacy and licences, metadata audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan.functions.text import has_sensitive_json_key
from siteplan.session import written

# Privacy classes from open to closed.
PRIVACY = ("public", "internal", "sensitive", "restricted")
# Rounds that are walked before what they found is compared with what is known.
ROUNDS_PER_CUT = 8


def lineage_members(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every artifact each run reaches through parents: ``run_id, artifact_id``.

    ``seeds``: run_id, artifact_id; ``catalog``: artifact_id, parent_ids.
    """
    members, names, runs = _numbered_members(seeds, catalog)
    named = members.join(names, "artifact", "left").join(runs, "run", "left")
    return named.select("run_id", "artifact_id")


def _numbered(values: DataFrame, number: str) -> DataFrame:
    """Each distinct value that is not null with a number of its own, fixed by writing it."""
    return written(values.dropna().distinct().withColumn(number, F.monotonically_increasing_id()))


def _numbered_members(seeds: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reached artifacts as numbers ``run, artifact``, and the names of both.

    Each round expands what the last one found, once per run and artifact. What some rounds found is compared with what is
    known only after them, so known rows are not moved in every round; the next round goes on from what was first found
    in the last one. All rows are two numbers, written as columns.
    """
    links = catalog.select("artifact_id", F.explode("parent_ids").alias("parent_id"))
    ids = catalog.select("artifact_id").unionByName(links.select(F.col("parent_id").alias("artifact_id"))).unionByName(seeds.select("artifact_id"))
    names, runs = _numbered(ids, "artifact"), _numbered(seeds.select("run_id"), "run")
    above = names.select(F.col("artifact_id").alias("parent_id"), F.col("artifact").alias("parent"))
    parents = written(links.join(names, "artifact_id").join(above, "parent_id", "left").select("artifact", "parent").distinct())
    front = written(seeds.join(names, "artifact_id", "left").join(runs, "run_id", "left").select("run", "artifact").distinct())
    known, turn = front, 0
    while True:
        steps = []
        for _ in range(ROUNDS_PER_CUT):
            front = written(front.join(parents, "artifact").select("run", F.col("parent").alias("artifact")).distinct())
            if front.isEmpty():
                break
            turn += 1
            steps.append(front.withColumn("turn", F.lit(turn)))
        if not steps:
            return known, names, runs
        # Rows without a run are never known: each round's count.
        found = reduce(DataFrame.unionByName, steps).groupBy("run", "artifact", F.when(F.col("run").isNull(), F.col("turn"))).agg(F.min("turn").alias("turn"))
        fresh = written(found.select("run", "artifact", "turn").join(known, ["run", "artifact"], "left_anti"))
        known = known.unionByName(fresh.select("run", "artifact"))
        if len(steps) < ROUNDS_PER_CUT:
            return known, names, runs
        front = fresh.filter(F.col("turn") == turn).select("run", "artifact")


def lineage_closure(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count, total and largest byte size of the artifacts each run reaches; an unknown id raises."""
    members, names, runs = _numbered_members(seeds, catalog)
    sizes = names.join(catalog.select("artifact_id", "byte_size"), "artifact_id", "left")
    sizes = sizes.select("artifact", "byte_size", F.when(F.col("byte_size").isNull(), F.col("artifact_id")).alias("unknown"))
    joined = members.join(sizes, "artifact", "left")
    bad = F.raise_error(F.concat(F.lit("unknown artifact "), F.col("unknown"))).cast("bigint")
    size = F.when(F.col("byte_size").isNull(), bad).otherwise(F.col("byte_size"))
    sums = joined.groupBy("run").agg(
        F.count(F.lit(1)).alias("artifact_count"), F.sum(size).alias("artifact_bytes"), F.max(size).alias("largest_artifact_bytes")
    )
    return sums.join(runs, "run", "left").select("run_id", "artifact_count", "artifact_bytes", "largest_artifact_bytes")


def inherit_provenance(children: DataFrame, catalog: DataFrame) -> DataFrame:
    """Strictest privacy and joined distinct licences (null = unknown) of each child's parents."""
    rank = F.array_position(F.array(*map(F.lit, PRIVACY)), F.col("privacy"))
    links = children.select("child_id", F.explode("parent_ids").alias("artifact_id")).distinct()
    joined = links.join(catalog.select("artifact_id", "privacy", "license"), "artifact_id")
    grouped = joined.groupBy("child_id").agg(
        F.max(rank).alias("_rank"), F.array_sort(F.collect_set(F.coalesce("license", F.lit("unknown")))).alias("_l")
    )
    return grouped.select(
        "child_id", F.element_at(F.array(*map(F.lit, PRIVACY)), F.col("_rank").cast("int")).alias("privacy"),
        F.array_join("_l", " AND ").alias("license"),
    )


def audit_catalog(catalog: DataFrame, metadata: str = "metadata") -> DataFrame:
    """One row over the catalog: licences, providers and the all-attributed style checks.

    ``catalog``: license, source_provider, source_uri, source_version, privacy, metadata JSON text.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return catalog.agg(
        F.count(F.lit(1)).alias("artifact_count"),
        F.array_sort(F.collect_set(F.coalesce("license", F.lit("")))).alias("licenses"),
        F.array_sort(F.collect_set(F.coalesce("source_provider", F.lit("")))).alias("source_providers"),
        F.every(F.col("privacy") == "public").alias("all_public"),
        F.every(filled("source_uri") & filled("source_provider") & filled("source_version")).alias("all_sources_attributed"),
        F.every(filled("license")).alias("all_licenses_declared"),
        F.every(~F.coalesce(has_sensitive_json_key(metadata), F.lit(False))).alias("no_sensitive_metadata_keys"),
    )


def reproducibility(runs: DataFrame, names: list[str]) -> DataFrame:
    """Whether every run names every identity field."""
    filled = [F.coalesce(F.col(n).cast("string"), F.lit("")) != "" for n in names]
    return runs.agg(F.every(F.forall(F.array(*filled), lambda v: v)).alias("reproducibility_complete"))
