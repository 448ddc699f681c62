"""Validity of problems, facility plans and allocations, as tables of issue codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.plans.scoring import (
    ACCESS_FAMILIES,
    CAPACITY_FAMILY,
    TOLERANCE,
    Evidence,
    access_by_scenario,
    demand_weights,
    site_totals,
)
from siteplan.session import shuffle_buckets, written

# How many times as many tasks as usual join the arcs of allocations.
ARC_SPREAD = 4


def _explode_codes(df: DataFrame, key: str, codes: dict[str, Column]) -> DataFrame:
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in codes.items()]))
    return df.select(key, F.explode(flags).alias("code"))


def unknown_ids(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rows naming ids the reference table does not have."""
    return df.join(reference.select(*keys).distinct(), keys, "left_anti")


def missing_existing(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Mandatory existing sites a plan omits: ``plan_id, site_id``."""
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    mandatory = keys.join(ev.sites.filter("existing").select("evidence_id", "site_id"), "evidence_id")
    return mandatory.select("plan_id", "site_id").join(plan_sites, ["plan_id", "site_id"], "left_anti")


def spacing_violations(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Pairs of a plan's sites closer than its minimum spacing: ``plan_id, left_site, right_site, distance``.

    Sites are dealt out by plan once. Four grids of cells twice as wide as the spacing, each shifted by half a cell,
    hold every such pair in a cell of one of them; only sites that share a cell of their plan with another one meet.
    """
    wanted = problems.filter(F.col("minimum_spacing") > 0).select("problem_id", "evidence_id", "minimum_spacing")
    keys = plans.join(wanted, "problem_id")
    listed = plan_sites.select("plan_id", "site_id").repartition(shuffle_buckets(plan_sites.sparkSession), "plan_id").distinct()
    placed = listed.join(keys, "plan_id").join(ev.sites.select("evidence_id", "site_id", "x", "y"), ["evidence_id", "site_id"])
    half = F.col("minimum_spacing") * (1 + 1e-6)
    cell = lambda c, shift: F.floor((F.col(c) / half + shift) / 2)
    grids = F.array(*[F.struct(F.lit(i).alias("gx"), F.lit(j).alias("gy"), cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (0, 1) for j in (0, 1)])
    meeting = ["plan_id", "gx", "gy", "cx", "cy"]
    at = placed.select("plan_id", "site_id", "x", "y", "minimum_spacing", F.explode(grids).alias("_g")).select("plan_id", "site_id", "x", "y", "minimum_spacing", "_g.*")
    together = Window.partitionBy(*meeting)
    crowded = at.withColumns({"_a": F.min("site_id").over(together), "_b": F.max("site_id").over(together)}).filter(F.col("_a") != F.col("_b"))
    crowded = written(crowded.drop("_a", "_b"))
    left = crowded.select(*meeting, "minimum_spacing", F.col("site_id").alias("left_site"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = crowded.select(*meeting, F.col("minimum_spacing").alias("_spacing"), F.col("site_id").alias("right_site"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = left.join(right, meeting).filter((F.col("left_site") < F.col("right_site")) & (F.col("minimum_spacing") == F.col("_spacing")))
    # A pair is told once, in the grid shifted only where it must be.
    first = lambda c: F.when(cell(f"{c}1", 0) == cell(f"{c}2", 0), 0).otherwise(1)
    pairs = pairs.filter((F.col("gx") == first("x")) & (F.col("gy") == first("y")))
    near = pairs.withColumn("distance", geo.euclidean("x1", "y1", "x2", "y2"))
    return near.filter(F.col("distance") + TOLERANCE < F.col("minimum_spacing")).select("plan_id", "left_site", "right_site", "distance")


def validate_allocations(allocations: DataFrame, plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Allocation issues per plan: ``plan_id, code``."""
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    need = ev.demand.select("evidence_id", "demand_id", "need")
    chosen = plan_sites.select("plan_id", "site_id").distinct().withColumn("selected", F.lit(True))
    # Rows are dealt out by arc over more tasks than usual, as both sides of this join are as long as the allocations.
    arc, spread = ["evidence_id", "demand_id", "site_id"], ARC_SPREAD * shuffle_buckets(allocations.sparkSession)
    base = ev.access.select(*arc, "scenario", "access").repartition(spread, *arc).groupBy(*arc).agg(
        F.min_by("access", F.struct((F.col("scenario") != "base"), "scenario")).alias("access")
    )
    arcs = (
        allocations.join(keys, "plan_id")
        .join(chosen, ["plan_id", "site_id"], "left")
        .join(ev.sites.select("evidence_id", "site_id", "capacity"), ["evidence_id", "site_id"], "left")
        .join(need, ["evidence_id", "demand_id"], "left")
        .repartition(spread, *arc).join(base, arc, "left")
    )
    # Written once: each rule reads its columns only and keeps a task to one aggregate.
    arcs = written(arcs.select("plan_id", "demand_id", "site_id", "amount", "need", "selected", "capacity", "access"))
    known = F.col("need").isNotNull() & F.coalesce("selected", F.lit(False)) & F.col("capacity").isNotNull()
    amount = F.col("amount")
    bad_amount = amount.isNull() | F.isnan(amount) | (amount <= 0) | (amount == float("inf"))
    per_arc = _explode_codes(
        arcs, "plan_id",
        {
            "invalid_allocation_arc": ~known,
            "invalid_allocation_amount": known & bad_amount,
            "unreachable_allocation": known & (F.col("access").isNull() | (F.col("access") == float("inf"))),
        },
    )
    finite = F.when(~F.isnan(amount) & (F.abs(amount) < float("inf")), amount)
    by_pair = arcs.filter(known).groupBy("plan_id", "demand_id", "site_id").count().filter("count > 1")
    by_demand = arcs.filter(F.col("need").isNotNull()).groupBy("plan_id", "demand_id").agg(F.sum(finite).alias("s"), F.first("need").alias("cap"))
    by_site = arcs.filter(F.col("capacity").isNotNull()).groupBy("plan_id", "site_id").agg(F.sum(finite).alias("s"), F.first("capacity").alias("cap"))
    over = F.col("s") > F.col("cap") + TOLERANCE
    issues = (
        per_arc.unionByName(by_pair.select("plan_id", F.lit("duplicate_allocation").alias("code")))
        .unionByName(by_demand.filter(over).select("plan_id", F.lit("demand_overallocation").alias("code")))
        .unionByName(by_site.filter(over).select("plan_id", F.lit("capacity_exceeded").alias("code")))
    )
    return issues.distinct()


def structural_issues(
    plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence,
    allocations: DataFrame | None = None, totals: DataFrame | None = None, access: DataFrame | None = None,
) -> DataFrame:
    """Rule violations of each plan before any target is looked at: ``plan_id, code``.

    ``totals`` and ``access`` may pass in ``site_totals`` and ``access_by_scenario`` already built.
    """
    totals = totals if totals is not None else site_totals(plan_sites, plans, problems, ev)
    rows = plans.join(problems, "problem_id").join(totals, "plan_id")
    over_limit = F.col("site_count") > F.col("site_limit")
    is_access = F.col("family").isin(*ACCESS_FAMILIES)
    issues = _explode_codes(
        rows, "plan_id",
        {
            "duplicate_site": F.col("listed") > F.col("distinct_sites"),
            "unknown_site": F.col("unknown_sites") > 0,
            "ineligible_site": F.col("ineligible_sites") > 0,
            "missing_existing": F.col("kept_existing") < F.col("existing_sites"),
            "new_site_limit": (F.col("family") == "incremental_coverage") & (F.col("new_sites") > F.col("new_site_limit")),
            "site_limit": over_limit,
            "financial_budget": F.col("opening_cost") > F.col("financial_budget") + TOLERANCE,
            "no_selected_site": is_access & (F.col("site_count") == 0),
            "insufficient_redundancy": (F.col("family") == "resilient_coverage") & (F.col("site_count") < F.col("redundancy")),
        },
    )
    close = spacing_violations(plan_sites, plans, problems, ev)
    issues = issues.unionByName(close.select("plan_id", F.lit("minimum_spacing").alias("code")).distinct())
    if ev.access is not None:
        if access is None:
            some = plans.join(problems.filter(is_access), "problem_id", "left_semi")
            access = access_by_scenario(plan_sites, some, problems, ev)
        unserved = access.filter((F.col("group_name") == "") & (F.col("unserved_rows") > 0))
        has_site = totals.filter("site_count > 0").select("plan_id")
        unserved = unserved.join(has_site, "plan_id", "left_semi")
        issues = issues.unionByName(unserved.select("plan_id", F.lit("unserved_access").alias("code")).distinct())
    if allocations is not None:
        capacity = plans.join(problems.filter(F.col("family") == CAPACITY_FAMILY), "problem_id", "left_semi")
        stray = allocations.join(capacity, "plan_id", "left_anti").select("plan_id").distinct()
        issues = issues.unionByName(stray.select("plan_id", F.lit("unsupported_allocations").alias("code")))
        checked = allocations.join(capacity, "plan_id", "left_semi")
        issues = issues.unionByName(validate_allocations(checked, plan_sites, capacity, problems, ev))
    return issues


def validate_problem(
    problems: DataFrame, ev: Evidence, floors: DataFrame | None = None,
    has_cost: bool = True, has_capacity: bool = True, has_existing: bool = True,
) -> DataFrame:
    """Problem issues: ``problem_id, code``. The flags say which candidate roles were declared."""
    counts = ev.sites.groupBy("evidence_id").agg(
        F.count_if("eligible").alias("n_eligible"), F.count_if("existing").alias("n_existing"),
        F.count_if(F.col("existing") & ~F.col("eligible")).alias("n_ineligible_existing"),
    )
    rows = problems.join(counts, "evidence_id", "left").fillna(0, ["n_eligible", "n_existing", "n_ineligible_existing"])
    if ev.groups is not None:
        named = ev.groups.select("evidence_id", "group_name").distinct()
        n_groups = named.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_groups"))
        rows = rows.join(n_groups, "evidence_id", "left").fillna(0, ["n_groups"])
    else:
        named = None
        rows = rows.withColumn("n_groups", F.lit(0))
    if floors is not None:
        asked = floors.join(problems.select("problem_id", "evidence_id"), "problem_id")
        per_problem = asked.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n_floors"))
        stray = asked if named is None else asked.join(named, ["evidence_id", "group_name"], "left_anti")
        stray = stray.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n_stray"))
        rows = rows.join(per_problem, "problem_id", "left").join(stray, "problem_id", "left").fillna(0, ["n_floors", "n_stray"])
    else:
        rows = rows.withColumns({"n_floors": F.lit(0), "n_stray": F.lit(0)})
    special = [t.select("evidence_id") for t in (ev.multipliers, ev.failed) if t is not None]
    if special:
        marked = special[0] if len(special) == 1 else special[0].unionByName(special[1])
        rows = rows.join(marked.distinct().withColumn("_special", F.lit(True)), "evidence_id", "left")
    else:
        rows = rows.withColumn("_special", F.lit(False))
    family, equity = F.col("family"), F.coalesce("equity", F.lit("none"))
    is_access = family.isin(*ACCESS_FAMILIES)
    limit = F.coalesce("site_limit", "n_eligible")
    codes = {
        "missing_budget": F.col("site_limit").isNull() & F.col("new_site_limit").isNull() & F.col("financial_budget").isNull(),
        "missing_cost": F.lit(not has_cost) & (F.col("financial_budget").isNotNull() | (family == "min_cost_target_coverage")),
        "unknown_group_floor": F.col("n_stray") > 0,
        "missing_groups": (equity != "none") & (F.col("n_groups") == 0),
        "unsupported_max_min": (equity == "max_min") & (family != "equity_coverage"),
        "coverage_policy_on_access_problem": is_access
        & (F.col("coverage_target").isNotNull() | (F.col("n_floors") > 0) | (equity != "none")),
        "unsupported_new_site_limit": F.col("new_site_limit").isNotNull() & (family != "incremental_coverage"),
        "missing_target": (family == "min_cost_target_coverage") & F.col("coverage_target").isNull(),
        "missing_site_limit": is_access & F.col("site_limit").isNull(),
        "missing_capacity": (family == CAPACITY_FAMILY) & F.lit(not has_capacity),
        "unsupported_capacity_scenario": (family == CAPACITY_FAMILY) & F.col("_special"),
        "missing_equity_policy": (family == "equity_coverage") & (equity == "none"),
        "missing_existing_sites": (family == "incremental_coverage") & F.lit(not has_existing),
        "missing_new_site_limit": (family == "incremental_coverage") & F.col("new_site_limit").isNull(),
        "insufficient_sites": (family == "resilient_coverage") & (limit < F.col("redundancy")),
        "ineligible_existing": F.col("n_ineligible_existing") > 0,
        "existing_over_limit": F.col("n_existing") > F.col("site_limit"),
        "no_candidates": F.col("n_eligible") == 0,
    }
    issues = _explode_codes(rows, "problem_id", codes)
    if ev.access is not None:
        issues = issues.unionByName(unreachable_demand(problems, ev))
    return issues


def unreachable_demand(problems: DataFrame, ev: Evidence) -> DataFrame:
    """Access problems whose positive demand has no usable site in some scenario."""
    some = problems.filter(F.col("family").isin(*ACCESS_FAMILIES)).select("problem_id", "evidence_id")
    usable = ev.sites.filter("eligible or existing").select("evidence_id", "site_id")
    reach = ev.access.filter(F.col("access") < float("inf")).join(usable, ["evidence_id", "site_id"], "left_semi")
    if ev.failed is not None:
        reach = reach.join(ev.failed, ["evidence_id", "scenario", "site_id"], "left_anti")
    keys = ["evidence_id", "scenario", "demand_id"]
    lost = demand_weights(ev).filter("weight > 0").join(reach.select(*keys).distinct(), keys, "left_anti")
    broken = lost.select("evidence_id").distinct()
    return some.join(broken, "evidence_id", "left_semi").select("problem_id", F.lit("unreachable_demand").alias("code"))


def matrix_mismatch(matrix: DataFrame, labels: DataFrame, label: str, ordinal: str, matrix_label: str, matrix_ord: str) -> DataFrame:
    """Labels of a matrix axis that differ from the expected labels and order (empty = aligned)."""
    axis = matrix.select(F.col(matrix_label).alias("label"), F.col(matrix_ord).alias("ord")).distinct().withColumn("_m", F.lit(1))
    wanted = labels.select(F.col(label).cast("string").alias("label"), F.col(ordinal).alias("ord")).withColumn("_w", F.lit(1))
    joined = axis.join(wanted, ["label", "ord"], "full_outer")
    return joined.filter(F.col("_m").isNull() | F.col("_w").isNull()).select("label", "ord")


def weight_issues(df: DataFrame, value: str, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """One row: missing and out-of-range values of a matrix or edge table."""
    v = F.col(value)
    return df.agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("missing"),
        F.count_if((v < low) | (v > high)).alias("out_of_range"),
    )
