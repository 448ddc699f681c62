"""Shortest paths and isochrones over edge tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan.session import cut_lineage

SALT = 8
ROUNDS_PER_CUT = 3


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    flipped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(flipped)


def check_weights(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Raise on null, non-finite or negative weights."""
    w = F.col(weight).cast("double")
    good = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < math.inf)
    raised = F.raise_error(F.lit("edge weights must be finite and non-negative")).cast("double")
    return edges.withColumn(weight, F.when(good, w).otherwise(raised))


def unknown_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Wanted nodes the graph does not have."""
    return wanted.select("node").distinct().join(nodes.select("node"), "node", "left_anti")


def shortest_paths(
    edges: DataFrame, origins: DataFrame, cutoff: float | None = None
) -> DataFrame:
    """Cost from every origin node to every node it reaches (``origin, node, cost``).

    Rounds of relaxation: only rows improved in the last round are joined with the edges, parallel
    edges are reduced first, and a cutoff prunes the frontier. The edges leaving a hub are spread
    over ``SALT`` tasks. State is checkpointed so the plan does not grow with the rounds.
    """
    steps = check_weights(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    steps = steps.withColumn("_salt", F.pmod(F.xxhash64("dst"), F.lit(SALT)).cast("int"))
    steps = cut_lineage(steps)
    best = origins.select(
        F.col("node").alias("origin"), F.col("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")
    )
    for round_number in itertools.count(1):
        front = best.filter("fresh").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        moves = (
            front.join(steps, (front["node"] == steps["src"]) & (front["_salt"] == steps["_salt"]))
            .select("origin", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))
        )
        if cutoff is not None:
            moves = moves.filter(F.col("cost") <= cutoff)
        settled = best.select("origin", "node", "cost", F.lit(True).alias("known"))
        merged = settled.unionByName(moves.withColumn("known", F.lit(False))).groupBy("origin", "node")
        best = merged.agg(
            F.min("cost").alias("cost"),
            F.min(F.when(F.col("known"), F.col("cost"))).alias("_old"),
        ).select(
            "origin", "node", "cost", (F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).alias("fresh")
        )
        if round_number % ROUNDS_PER_CUT == 0:
            best = cut_lineage(best)
            if best.filter("fresh").isEmpty():
                return best.drop("fresh")


def isochrones(edges: DataFrame, origins: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Reached nodes per origin and cutoff as rows (``origin, cutoff, node, cost``)."""
    cuts = [float(c) for c in cutoffs]
    if not cuts or sorted(set(cuts)) != cuts or cuts[0] < 0 or math.isinf(cuts[-1]):
        raise ValueError("cutoffs must be finite, non-negative, unique and increasing")
    costs = shortest_paths(edges, origins, cutoff=cuts[-1])
    wanted = F.array(*[F.lit(c) for c in cuts])
    return costs.withColumn("cutoff", F.explode(F.filter(wanted, lambda c: c >= F.col("cost"))))


def isochrone_sets(reached: DataFrame) -> DataFrame:
    """The sorted node array per origin and cutoff, the form a report shows."""
    return reached.groupBy("origin", "cutoff").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
