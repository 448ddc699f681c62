"""Scorecards: validity, metrics, objective and comparator of many plans in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan.plans import scoring as s
from siteplan.plans.validation import structural_issues


def _empty(plans: DataFrame, columns: Sequence[str]) -> DataFrame:
    return plans.limit(0).select("plan_id", *[F.lit(None).cast("double").alias(c) for c in columns])


def score_plans(
    problems: DataFrame,
    plans: DataFrame,
    plan_sites: DataFrame,
    ev: s.Evidence,
    allocations: DataFrame | None = None,
    floors: DataFrame | None = None,
    families: Sequence[str] = s.FAMILIES,
) -> DataFrame:
    """One row per plan: violations, feasibility, metrics, raw objective and comparator.

    ``families`` names the families present, so that no job runs for the others.
    """
    def of(*names: str) -> DataFrame:
        return plans.join(problems.filter(F.col("family").isin(*names)), "problem_id", "left_semi")

    totals = s.site_totals(plan_sites, plans, problems, ev)
    by_scenario = None
    metrics = ["coverage", "average_access", "maximum_access", "quantile_access", "served_demand", "unmet_demand"]
    parts, groups = [], []

    def collect(table: DataFrame) -> None:
        whole = table.filter(F.col("group_name") == s.OVERALL)
        parts.append(whole.select("plan_id", *[c for c in metrics if c in table.columns]))
        if "coverage" in table.columns:
            groups.append(table.filter(F.col("group_name") != s.OVERALL).select("plan_id", "group_name", "coverage"))

    covering = [f for f in families if f in s.COVERAGE_FAMILIES]
    if covering:
        collect(s.coverage_metrics(plan_sites, of(*covering), problems, ev))
    reaching = [f for f in families if f in s.ACCESS_FAMILIES]
    if reaching and ev.access is not None:
        some = of(*reaching)
        by_scenario = s.access_by_scenario(plan_sites, some, problems, ev)
        collect(s.access_metrics(plan_sites, some, problems, ev))
    if s.CAPACITY_FAMILY in families and allocations is not None:
        collect(s.allocation_metrics(allocations, of(s.CAPACITY_FAMILY), problems, ev))
    if not parts:
        raise ValueError("no family can be scored with the evidence given")
    measured = parts[0]
    for part in parts[1:]:
        measured = measured.unionByName(part, allowMissingColumns=True)
    absent = [c for c in metrics if c not in measured.columns]
    measured = measured.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else measured

    rows = plans.join(problems, "problem_id").join(totals, "plan_id").join(measured, "plan_id", "left")
    if "resilient_coverage" in families:
        tough = s.resilience_metrics(plan_sites, of("resilient_coverage"), problems, ev)
        rows = rows.join(s._pick(tough, s.OVERALL), "plan_id", "left")
    else:
        rows = rows.join(_empty(plans, ["one_failure_coverage", "redundant_coverage"]), "plan_id", "left")

    by_group = None
    for table in groups:
        by_group = table if by_group is None else by_group.unionByName(table)
    if by_group is not None and ev.groups is not None:
        worst = by_group.groupBy("plan_id").agg(
            F.min("coverage").alias("worst_group"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("group_name", "coverage")))).alias("group_coverage"),
        )
        rows = rows.join(worst, "plan_id", "left")
    else:
        rows = rows.withColumns(
            {"worst_group": F.lit(None).cast("double"), "group_coverage": F.lit(None).cast("map<string,double>")}
        )
    rows = rows.withColumn("worst_group", F.coalesce("worst_group", F.lit(1.0)))

    issues = structural_issues(plan_sites, plans, problems, ev, allocations, totals, by_scenario)
    found = issues.groupBy("plan_id").agg(F.array_sort(F.collect_set("code")).alias("_structural"))
    rows = rows.join(found, "plan_id", "left")
    clean = F.col("_structural").isNull()
    reached = F.coalesce("coverage", F.lit(0.0)) + s.TOLERANCE >= F.col("coverage_target")
    short = clean & F.coalesce(~reached, F.lit(False))
    if floors is not None and by_group is not None:
        asked = floors.join(plans, "problem_id").join(by_group, ["plan_id", "group_name"], "left")
        low = asked.filter(F.coalesce("coverage", F.lit(0.0)) + s.TOLERANCE < F.col("floor")).select("plan_id").distinct()
        rows = rows.join(low.withColumn("_low", F.lit(True)), "plan_id", "left")
    else:
        rows = rows.withColumn("_low", F.lit(False))
    below = clean & F.coalesce("_low", F.lit(False))
    target = F.array_compact(F.array(F.when(short, F.lit("coverage_target")), F.when(below, F.lit("group_floor"))))
    rows = rows.withColumn("violations", F.coalesce("_structural", target))
    rows = rows.withColumn("feasible", F.size("violations") == 0)
    key = F.when(F.col("feasible"), s.comparator_key()).otherwise(F.array(F.lit(s.INFEASIBLE)))
    raw = F.when(clean, s.raw_objective())
    return rows.select(
        "plan_id", "problem_id", "family", "feasible", "violations", "site_count", "opening_cost", *metrics,
        "one_failure_coverage", "redundant_coverage", "worst_group", "group_coverage",
        raw.alias("raw_objective"), key.alias("comparator"),
    )


def plan_summary(scores: DataFrame, plan_sites: DataFrame) -> DataFrame:
    """Short report row per plan: primary metric, selected sites in order, violations."""
    sites = plan_sites.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "site_id"))), lambda e: e["site_id"]).alias("selected_site_ids")
    )
    named = F.map_keys("raw_objective")
    primary = F.when(F.size(named) > 0, F.element_at(named, 1))
    value = F.when(F.size(named) > 0, F.element_at(F.map_values("raw_objective"), 1))
    return scores.join(sites, "plan_id", "left").select(
        "plan_id", "problem_id", "family", "feasible", "selected_site_ids",
        primary.alias("primary_metric"), value.alias("primary_value"), "comparator", "violations",
    )
