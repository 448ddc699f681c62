"""Plan search as table work: neighbourhoods, enumeration, greedy construction, improvement passes.

Candidates are addressed by ordinal and decoded by arithmetic, so a slice of a neighbourhood costs
its own size and never the size of the whole neighbourhood.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.functions.arrays import choose, combination_at, pair_at
from siteplan.functions.text import descending_code_points
from siteplan.operators.ordered import positions, running
from siteplan.plans import scoring as s
from siteplan.plans.scorecards import score_plans
from siteplan.session import cut_lineage

def ranked_sites(ev: s.Evidence, order: str = "ord") -> DataFrame:
    """Sites with ``rank``: 0-based position among the selectable (eligible, not existing) sites."""
    free = ev.sites.filter("eligible and not existing")
    ranked = positions(free.select("evidence_id", "site_id", order), ["evidence_id"], [order], name="_p")
    ranked = ranked.select("evidence_id", "site_id", (F.col("_p") - 1).alias("rank"))
    return ev.sites.join(ranked, ["evidence_id", "site_id"], "left")


def _plan_arrays(plans: DataFrame, plan_sites: DataFrame, problems: DataFrame, sites: DataFrame, order: str) -> DataFrame:
    """Plans with their selected sites as a sorted array (at most one site limit long)."""
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    entry = F.struct(F.col(order).cast("bigint").alias("ord"), "site_id", "rank", "existing")
    rows = keys.join(plan_sites.select("plan_id", "site_id").distinct(), "plan_id", "left")
    rows = rows.join(sites.select("evidence_id", "site_id", order, "rank", "existing"), ["evidence_id", "site_id"], "left")
    packed = rows.groupBy("plan_id", "problem_id", "evidence_id").agg(
        F.array_sort(F.collect_list(F.when(F.col(order).isNotNull(), entry))).alias("selected")
    )
    sizes = sites.groupBy("evidence_id").agg(F.count("rank").alias("free_sites"))
    return packed.join(sizes, "evidence_id")


def neighborhood_sizes(plans: DataFrame, plan_sites: DataFrame, problems: DataFrame, ev: s.Evidence, multi: bool = False, order: str = "ord") -> DataFrame:
    """``plan_id, total``: additions, swaps and, with ``multi``, double swaps."""
    arrays = _plan_arrays(plans, plan_sites, problems, ranked_sites(ev, order), order)
    return arrays.select("plan_id", _sizes(multi)["total"].alias("total"))


def _sizes(multi: bool) -> dict[str, Column]:
    removable = F.size(F.filter("selected", lambda e: ~e["existing"])).cast("bigint")
    unselected = F.col("free_sites") - F.size(F.filter("selected", lambda e: e["rank"].isNotNull()))
    pairs = lambda n: n * (n - 1) / 2
    total = unselected + removable * unselected
    if multi:
        total = total + (pairs(removable) * pairs(unselected)).cast("bigint")
    return {"removable": removable, "unselected": unselected, "total": total.cast("bigint")}


def neighbors(
    plans: DataFrame, plan_sites: DataFrame, problems: DataFrame, ev: s.Evidence,
    multi: bool = False, start: Column | int = 0, limit: int | None = None, order: str = "ord",
) -> tuple[DataFrame, DataFrame]:
    """Add, swap (and double-swap) neighbours in fixed order, ordinals ``start`` to ``start + limit``.

    Returns neighbour plans (plan_id, problem_id, parent_id, ordinal, total) and their site rows.
    """
    sites = ranked_sites(ev, order)
    arrays = _plan_arrays(plans, plan_sites, problems, sites, order).withColumns(_sizes(multi))
    first = start if isinstance(start, Column) else F.lit(start)
    last = F.col("total") - 1 if limit is None else F.least(F.col("total"), first + limit) - 1
    span = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    rows = arrays.withColumn("ordinal", F.explode(span))
    n, r, at = F.col("unselected"), F.col("removable"), F.col("ordinal")
    swap_at, double_at = at - n, at - n - r * n
    n_pairs = (n * (n - 1) / 2).cast("bigint")
    is_add, is_swap = at < n, (at >= n) & (at < n + r * n)
    out_pair = pair_at(F.floor(double_at / F.greatest(n_pairs, F.lit(1))), r)
    in_pair = pair_at(double_at % F.greatest(n_pairs, F.lit(1)), n)
    rows = rows.withColumns(
        {
            "_out1": F.when(is_swap, F.floor(swap_at / F.greatest(n, F.lit(1)))).when(~is_add, out_pair[0]),
            "_out2": F.when(~is_add & ~is_swap, out_pair[1]),
            "_in1": F.when(is_add, at).when(is_swap, swap_at % F.greatest(n, F.lit(1))).otherwise(in_pair[0]),
            "_in2": F.when(~is_add & ~is_swap, in_pair[1]),
        }
    )
    taken = F.array_sort(F.transform(F.filter("selected", lambda e: e["rank"].isNotNull()), lambda e: e["rank"]))
    # The u-th unselected site is found by stepping over the selected ranks at or below it.
    shift = lambda u: F.aggregate(taken, u, lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc))
    rows = rows.withColumns({"_in1": shift(F.col("_in1")), "_in2": F.when(F.col("_in2").isNotNull(), shift(F.col("_in2")))})
    entry = F.struct(F.col(order).cast("bigint").alias("ord"), "site_id", "rank", "existing")
    lookup = sites.filter("rank is not null").select("evidence_id", F.col("rank").alias("_r"), entry.alias("_e"))
    rows = rows.join(lookup.withColumnsRenamed({"_r": "_in1", "_e": "_add1"}), ["evidence_id", "_in1"])
    if multi:
        rows = rows.join(lookup.withColumnsRenamed({"_r": "_in2", "_e": "_add2"}), ["evidence_id", "_in2"], "left")
    else:
        rows = rows.withColumn("_add2", F.lit(None).cast(sites.select(entry.alias("e")).schema["e"].dataType))
    movable = F.filter("selected", lambda e: ~e["existing"])
    gone = F.array_compact(F.array(F.get(movable, F.col("_out1"))["site_id"], F.get(movable, F.col("_out2"))["site_id"]))
    kept = F.filter("selected", lambda e: ~F.array_contains(gone, e["site_id"]))
    chosen = F.array_sort(F.concat(kept, F.array_compact(F.array("_add1", "_add2"))))
    named = rows.select(
        F.concat_ws("/", "plan_id", F.col("ordinal").cast("string")).alias("plan_id"), "problem_id",
        F.col("plan_id").alias("parent_id"), "ordinal", "total", F.transform(chosen, lambda e: e["site_id"]).alias("sites"),
    )
    listed = named.select("plan_id", F.posexplode("sites").alias("ord", "site_id"))
    return named, listed.select("plan_id", "site_id", "ord")


def subset_limits(problems: DataFrame, ev: s.Evidence) -> DataFrame:
    """Per problem: mandatory count, free sites, smallest and largest number of additions."""
    counts = ev.sites.groupBy("evidence_id").agg(
        F.count_if("existing").alias("mandatory"), F.count_if(F.col("eligible") & ~F.col("existing")).alias("free_sites")
    )
    rows = problems.join(counts, "evidence_id")
    mandatory, free = F.col("mandatory"), F.col("free_sites")
    room = F.greatest(F.col("site_limit") - mandatory, F.lit(0))
    new = F.least(F.coalesce("new_site_limit", F.lit(0)), F.coalesce(room, free), free)
    most = F.when(F.col("family") == "incremental_coverage", new).otherwise(F.least(F.coalesce(room, free), free))
    least = (
        F.when(F.col("family").isin(*s.ACCESS_FAMILIES) & (mandatory == 0), F.lit(1))
        .when(F.col("family") == "resilient_coverage", F.greatest(F.col("redundancy") - mandatory, F.lit(0)))
        .otherwise(F.lit(0))
    )
    return rows.withColumns({"fewest": least.cast("bigint"), "most": most.cast("bigint")})


def enumerate_plans(problems: DataFrame, ev: s.Evidence, cap: int, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` site subsets by size, then index order, with the known ``total``.

    The candidate cap is the operator's own parameter: ``total`` tells whether it was complete.
    """
    limits = subset_limits(problems, ev)
    sizes = F.when(F.col("fewest") <= F.col("most"), F.sequence("fewest", "most"))
    counted = F.aggregate(
        F.coalesce(sizes, F.array().cast("array<bigint>")),
        F.array().cast("array<struct<size:bigint,before:double,count:double>>"),
        lambda acc, k: F.concat(
            acc,
            F.array(
                F.struct(
                    k.alias("size"),
                    F.when(F.size(acc) == 0, 0.0).otherwise(
                        F.try_element_at(acc, F.lit(-1))["before"] + F.try_element_at(acc, F.lit(-1))["count"]
                    ).alias("before"),
                    choose(F.col("free_sites"), k).alias("count"),
                )
            ),
        ),
    )
    rows = limits.withColumn("_sizes", counted)
    last = F.try_element_at("_sizes", F.lit(-1))
    total = F.coalesce(last["before"] + last["count"], F.lit(0.0))
    inexact = F.raise_error(F.lit("more subsets than a total can count exactly")).cast("double")
    rows = rows.withColumn("total", F.when(total <= 2.0**53, total).otherwise(inexact))
    rows = rows.withColumn("_s", F.explode("_sizes")).filter(F.col("_s.before") < cap)
    count = F.least(F.col("_s.count"), F.lit(float(cap)) - F.col("_s.before")).cast("bigint")
    rows = rows.withColumn("_index", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    picks = combination_at(F.col("free_sites"), F.col("_s.size"), F.col("_index"))
    rows = rows.select(
        "problem_id", "evidence_id", (F.col("_s.before").cast("bigint") + F.col("_index")).alias("ordinal"),
        F.col("total").cast("bigint").alias("total"), picks.alias("ranks"),
    )
    rows = rows.withColumn("plan_id", F.concat_ws("/", "problem_id", F.col("ordinal").cast("string")))
    sites = ranked_sites(ev, order)
    free = sites.filter("rank is not null").select("evidence_id", "rank", "site_id", F.col(order).cast("bigint").alias("ord"))
    added = rows.select("plan_id", "evidence_id", F.explode("ranks").alias("rank")).join(free, ["evidence_id", "rank"])
    fixed = rows.select("plan_id", "evidence_id").join(
        sites.filter("existing").select("evidence_id", "site_id", F.col(order).cast("bigint").alias("ord")), "evidence_id"
    )
    listed = added.select("plan_id", "site_id", "ord").unionByName(fixed.select("plan_id", "site_id", "ord"))
    return rows.select("plan_id", "problem_id", "ordinal", "total"), listed


def reference_solution(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best scored plan per problem labelled ``exact_optimum``, ``best_known`` or ``infeasible``."""
    rows = scores.join(candidates.select("plan_id", "ordinal", "total"), "plan_id")
    seen = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("evaluated"), F.first("total").alias("total"))
    best = s.best_plan(rows, ["problem_id"]).drop("total")
    joined = seen.join(best, "problem_id", "left")
    complete = F.col("evaluated") >= F.col("total")
    kind = (
        F.when(F.col("plan_id").isNotNull() & complete, "exact_optimum")
        .when(F.col("plan_id").isNotNull(), "best_known")
        .when(complete, "infeasible")
        .otherwise("unknown")
    )
    return joined.withColumn("kind", kind)


def incumbent_timeline(candidates: DataFrame, keys: Sequence[str], order: str, comparator: str = "comparator") -> DataFrame:
    """Feasible candidates strictly better than every earlier one (keys rounded to the tolerance)."""
    rounded = F.transform(F.col(comparator), lambda v: F.round(v, 9))
    feasible = candidates.filter("feasible").withColumn("_key", rounded)
    scanned = running(feasible, keys, [order], {"_before": ("max", F.col("_key"))}, inclusive=False)
    return scanned.filter(F.col("_before").isNull() | (F.col("_key") > F.col("_before"))).drop("_key", "_before")


def improve(
    problems: DataFrame, plans: DataFrame, plan_sites: DataFrame, ev: s.Evidence,
    strategy: str = "add_swap", start: int = 0, limit: int | None = None, floors: DataFrame | None = None,
    families: Sequence[str] = s.FAMILIES, order: str = "ord",
) -> tuple[DataFrame, DataFrame]:
    """Evaluate a strategy, or with ``limit`` one slice of it, and return (strict improvements in order, status per plan).

    Status holds evaluated, total, next_ordinal and ``complete`` or ``partial``; an enumeration that is
    complete proves its best value.
    """
    ev = ev.settled()
    if strategy == "exact_enumeration":
        found, listed = enumerate_plans(problems, ev, start + limit if limit is not None else 1 << 62, order)
        found = found.filter(F.col("ordinal") >= start).join(plans.select("problem_id", F.col("plan_id").alias("parent_id")), "problem_id")
    elif strategy in ("add_swap", "multi_swap", "scenario_aware"):
        found, listed = neighbors(plans, plan_sites, problems, ev, strategy == "multi_swap", start, limit, order)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    found = cut_lineage(found)
    if "sites" in found.columns:
        listed = found.select("plan_id", F.explode("sites").alias("site_id"))
    else:
        listed = cut_lineage(listed.join(found.select("plan_id"), "plan_id", "left_semi"))
    # The current plans are scored with their neighbours, as ordinal -1.
    current = plans.select(
        F.col("plan_id").cast("string"), "problem_id", F.col("plan_id").cast("string").alias("parent_id"), F.lit(-1).cast("bigint").alias("ordinal")
    )
    together = found.select("plan_id", "problem_id", F.col("parent_id").cast("string"), "ordinal").unionByName(current)
    rows = listed.select("plan_id", "site_id").unionByName(plan_sites.select(F.col("plan_id").cast("string"), "site_id"))
    scores = score_plans(problems, together.select("plan_id", "problem_id"), rows, ev, floors=floors, families=families)
    scores = scores.join(together.select("plan_id", "parent_id", "ordinal"), "plan_id")
    timeline = incumbent_timeline(scores, ["parent_id"], "ordinal")
    status = found.groupBy("parent_id").agg(F.count(F.lit(1)).alias("evaluated"), F.first("total").alias("total"))
    done = F.lit(start) + F.col("evaluated") >= F.col("total")
    status = status.withColumns(
        {
            "next_ordinal": F.when(~done, F.lit(start) + F.col("evaluated")),
            "status": F.when(done, "complete").otherwise("partial"),
            "optimal": done & F.lit(strategy == "exact_enumeration" and start == 0),
        }
    )
    return timeline.filter("ordinal >= 0"), status


def _best_candidate(scored: DataFrame, key: Column) -> DataFrame:
    """Largest key per problem; ties by the greedy id order."""
    rank = F.struct(key.alias("key"), descending_code_points(F.col("site_id")).alias("name"))
    return scored.groupBy("problem_id").agg(F.max_by(F.struct("*"), rank).alias("_b")).select("_b.*")


def _within_limits(problems: DataFrame, chosen: DataFrame, ev: s.Evidence) -> DataFrame:
    """Free sites each problem may still add: count limits, budget and spacing hold with the addition."""
    limits = subset_limits(problems, ev).select(
        "problem_id", "evidence_id", "mandatory", "most", "financial_budget", "minimum_spacing"
    )
    costs = chosen.join(ev.sites.select("evidence_id", "site_id", "opening_cost", "existing", "x", "y"), ["evidence_id", "site_id"])
    spent = costs.groupBy("problem_id").agg(
        F.coalesce(F.sum(F.when(~F.col("existing"), F.col("opening_cost"))), F.lit(0.0)).alias("spent"),
        F.count_if(~F.col("existing")).alias("added"),
    )
    open_problems = limits.join(spent, "problem_id", "left").fillna(0, ["spent", "added"])
    open_problems = open_problems.filter(F.col("added") < F.col("most"))
    free = ev.sites.filter("eligible and not existing").select("evidence_id", "site_id", "opening_cost", "x", "y")
    options = open_problems.join(free, "evidence_id").join(chosen.select("problem_id", "site_id"), ["problem_id", "site_id"], "left_anti")
    affordable = F.col("spent") + F.col("opening_cost") <= F.col("financial_budget") + s.TOLERANCE
    options = options.filter(F.col("financial_budget").isNull() | affordable)
    spaced = options.filter(F.col("minimum_spacing") > 0)
    cell = lambda c: F.floor(F.col(c) / F.col("minimum_spacing"))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    near = costs.join(limits.filter(F.col("minimum_spacing") > 0).select("problem_id", "minimum_spacing"), "problem_id")
    near = near.select("problem_id", F.col("x").alias("x2"), F.col("y").alias("y2"), around("x").alias("cx"), cell("y").alias("_cy"))
    near = near.withColumn("cy", F.explode(F.sequence(F.col("_cy") - 1, F.col("_cy") + 1)))
    hit = spaced.withColumns({"cx": cell("x"), "cy": cell("y")}).join(near, ["problem_id", "cx", "cy"])
    blocked = hit.filter(geo.euclidean("x", "y", "x2", "y2") + s.TOLERANCE < F.col("minimum_spacing"))
    return options.join(blocked.select("problem_id", "site_id").distinct(), ["problem_id", "site_id"], "left_anti")


def greedy_coverage(problems: DataFrame, ev: s.Evidence, max_rounds: int) -> DataFrame:
    """Greedy baseline of the coverage families: ``problem_id, site_id, step`` (existing sites: step 0).

    Each round adds, per problem, the site with the best coverage gain (per cost for the minimum-cost
    family) and keeps only the best benefit per demand, so a round is one join of the service rows
    with that state, whatever the number of sites already chosen. ``max_rounds`` must cover the
    largest number of additions; fewer raises.
    """
    known = problems.filter(F.col("family").isin("max_weighted_coverage", "incremental_coverage", "min_cost_target_coverage"))
    weights = s.demand_weights(ev)
    pairs = s._available(ev.service, ev).filter(F.col("benefit") > 0)
    pairs = cut_lineage(pairs.join(weights.select("evidence_id", "scenario", "demand_id", "weight"), ["evidence_id", "scenario", "demand_id"]))
    totals = s._totals(weights, ev).filter(F.col("group_name") == s.OVERALL).select("evidence_id", "scenario", "scenario_total")
    frame = known.select("problem_id", "evidence_id", "aggregation").join(
        ev.scenarios.withColumnRenamed("weight", "scenario_weight"), "evidence_id"
    ).join(totals, ["evidence_id", "scenario"])
    frame = cut_lineage(frame)
    existing = known.select("problem_id", "evidence_id").join(ev.sites.filter("existing").select("evidence_id", "site_id"), "evidence_id")
    chosen = cut_lineage(existing.withColumn("step", F.lit(0)))
    served = chosen.join(pairs, ["evidence_id", "site_id"]).groupBy("problem_id", "scenario", "demand_id").agg(
        F.max("benefit").alias("best"), F.max("weight").alias("weight")
    )
    served = cut_lineage(served)
    active = known
    for step in range(1, max_rounds + 2):
        covered = served.groupBy("problem_id", "scenario").agg(F.sum(F.col("best") * F.col("weight")).alias("covered"))
        by_scenario = frame.join(covered, ["problem_id", "scenario"], "left").fillna(0.0, ["covered"])
        now = by_scenario.withColumn("coverage", s._mean(F.col("covered"), F.col("scenario_total"))).groupBy("problem_id").agg(
            s._fold_scenarios("coverage").alias("current")
        )
        # Problems that reach their target are done; others stop when nothing improves.
        state = active.join(now, "problem_id")
        met = (F.col("family") == "min_cost_target_coverage") & (F.col("current") + s.TOLERANCE >= F.col("coverage_target"))
        state = state.filter(~F.coalesce(met, F.lit(False)))
        options = _within_limits(state, chosen, ev).select("problem_id", "evidence_id", "site_id", "opening_cost")
        moves = options.join(pairs, ["evidence_id", "site_id"]).join(
            served.select("problem_id", "scenario", "demand_id", "best"), ["problem_id", "scenario", "demand_id"], "left"
        )
        gain = F.greatest(F.col("benefit") - F.coalesce("best", F.lit(0.0)), F.lit(0.0)) * F.col("weight")
        gains = moves.groupBy("problem_id", "site_id", "scenario").agg(F.sum(gain).alias("gain"))
        tried = options.join(by_scenario.drop("evidence_id"), "problem_id").join(gains, ["problem_id", "site_id", "scenario"], "left")
        tried = tried.withColumn("coverage", s._mean(F.col("covered") + F.coalesce("gain", F.lit(0.0)), F.col("scenario_total")))
        tried = tried.groupBy("problem_id", "evidence_id", "site_id").agg(
            s._fold_scenarios("coverage").alias("coverage"), F.max("opening_cost").alias("opening_cost")
        ).join(state.select("problem_id", "family", "current", "coverage_target"), "problem_id")
        # Coverage is compared at the tolerance, so sums added in another order cannot split a tie.
        level = F.round("coverage", 9)
        marginal = F.greatest(level - F.round("current", 9), F.lit(0.0))
        ratio = F.when(F.col("opening_cost") > 0, F.round(marginal / F.col("opening_cost"), 9)).otherwise(F.lit(float("inf")))
        key = F.when(F.col("family") == "min_cost_target_coverage", F.array(ratio, level, -F.col("opening_cost"))).otherwise(
            F.array(level, -F.col("opening_cost"))
        )
        pick = _best_candidate(tried, key)
        waiting = F.col("coverage_target").isNotNull() & (F.col("current") + s.TOLERANCE < F.col("coverage_target"))
        first_site = chosen.select("problem_id").distinct().withColumn("_has", F.lit(True))
        pick = pick.join(first_site, "problem_id", "left")
        improves = F.round("coverage", 9) > F.round("current", 9)
        pick = cut_lineage(pick.filter(improves | waiting | F.col("_has").isNull()).drop("_has"))
        if pick.isEmpty():
            return chosen.select("problem_id", "site_id", "step")
        if step > max_rounds:
            raise ValueError("max_rounds is smaller than the number of sites the problems allow")
        added = pick.select("problem_id", "evidence_id", "site_id", F.lit(step).alias("step"))
        chosen = cut_lineage(chosen.unionByName(added, allowMissingColumns=True))
        fresh = added.join(pairs, ["evidence_id", "site_id"]).select("problem_id", "scenario", "demand_id", F.col("benefit").alias("best"), "weight")
        served = cut_lineage(
            served.unionByName(fresh).groupBy("problem_id", "scenario", "demand_id").agg(F.max("best").alias("best"), F.max("weight").alias("weight"))
        )
        active = known.join(pick.select("problem_id"), "problem_id", "left_semi")
    return chosen.select("problem_id", "site_id", "step")


def _relaxed_key() -> Column:
    """Greedy key that ignores targets, from the columns of a score row."""
    family, cost = F.col("family"), -F.col("opening_cost")
    average = -F.coalesce("average_access", F.lit(float("inf")))
    ten = lambda c: F.round(c, 9)
    fair = F.array(ten(F.col("worst_group")), ten(F.col("coverage")), cost)
    return (
        F.when(family == "weighted_p_median", F.array(ten(average), cost))
        .when(family == "p_center", F.array(ten(-F.coalesce("maximum_access", F.lit(float("inf")))), ten(average)))
        .when(family == "quantile_access", F.array(ten(-F.coalesce("quantile_access", F.lit(float("inf")))), ten(average)))
        .when(family == "resilient_coverage", F.array(ten(F.col("one_failure_coverage")), ten(F.col("coverage")), cost))
        .when(F.col("equity") == "max_min", fair)
        .otherwise(F.array(ten(F.col("coverage")), cost))
    )


def greedy_plan(problems: DataFrame, ev: s.Evidence, max_rounds: int, floors: DataFrame | None = None, families: Sequence[str] = s.FAMILIES) -> DataFrame:
    """Greedy baseline of the access, equity and resilience families: ``problem_id, site_id, step``.

    Each round scores every admissible addition of every problem as a plan and keeps the best.
    P-center and quantile problems first look at their farthest demand.
    """
    ev = ev.settled()
    existing = problems.select("problem_id", "evidence_id").join(ev.sites.filter("existing").select("evidence_id", "site_id"), "evidence_id")
    chosen = cut_lineage(existing.select("problem_id", "evidence_id", "site_id", F.lit(0).alias("step")))
    limits = subset_limits(problems, ev).select("problem_id", F.col("fewest").alias("required"))
    active = problems
    current = None
    for step in range(1, max_rounds + 2):
        options = _within_limits(active, chosen, ev).select("problem_id", "evidence_id", "site_id")
        options = options.withColumn("plan_id", F.concat_ws("+", "problem_id", "site_id"))
        held = options.select("plan_id", "problem_id").join(chosen.select("problem_id", "site_id"), "problem_id")
        rows = options.select("plan_id", "site_id").unionByName(held.select("plan_id", "site_id")).withColumn("ord", F.lit(0))
        scores = score_plans(problems, options.select("plan_id", "problem_id"), rows, ev, floors=floors, families=families)
        tried = scores.join(options.select("plan_id", "evidence_id", "site_id"), "plan_id").join(problems.select("problem_id", "equity"), "problem_id")
        tried = tried.withColumn("relaxed", _relaxed_key()).withColumn("key", F.col("relaxed"))
        if ev.access is not None:
            far = _farthest_access(problems, chosen, ev)
            tried = tried.join(far, ["problem_id", "site_id"], "left").join(
                chosen.select("problem_id").distinct().withColumn("_held", F.lit(True)), "problem_id", "left"
            )
            looks = F.col("family").isin("p_center", "quantile_access") & F.col("_held")
            tried = tried.withColumn("key", F.when(looks, F.concat(F.array(-F.coalesce("far", F.lit(float("inf")))), "relaxed")).otherwise(F.col("relaxed")))
        pick = _best_candidate(tried.select("problem_id", "evidence_id", "site_id", "feasible", "relaxed", "key"), F.col("key"))
        pick = pick.join(limits, "problem_id")
        if current is not None:
            before = current.select("problem_id", F.col("feasible").alias("_f"), F.col("relaxed").alias("_k"))
            pick = pick.join(before, "problem_id", "left")
            stop = (F.lit(step - 1) >= F.col("required")) & F.col("_f") & (F.col("relaxed") <= F.col("_k"))
            pick = pick.filter(~F.coalesce(stop, F.lit(False))).drop("_f", "_k")
        pick = cut_lineage(pick)
        if pick.isEmpty():
            break
        if step > max_rounds:
            raise ValueError("max_rounds is smaller than the number of sites the problems allow")
        added = pick.select("problem_id", "evidence_id", "site_id", F.lit(step).alias("step"))
        chosen = cut_lineage(chosen.unionByName(added))
        current = pick
        active = problems.join(pick.select("problem_id"), "problem_id", "left_semi")
    return chosen.select("problem_id", "site_id", "step")


def _farthest_access(problems: DataFrame, chosen: DataFrame, ev: s.Evidence) -> DataFrame:
    """Access of every site to the farthest positive demand of each problem."""
    base = ev.access.groupBy("evidence_id", "demand_id", "site_id").agg(
        F.min_by("access", F.struct(F.col("scenario") != "base", "scenario")).alias("access")
    )
    near = chosen.join(base, ["evidence_id", "site_id"]).groupBy("problem_id", "demand_id").agg(F.min("access").alias("near"))
    held = chosen.select("problem_id", "evidence_id").distinct()
    rows = held.join(ev.demand.filter("need > 0").select("evidence_id", "demand_id", "need"), "evidence_id")
    rows = rows.join(near, ["problem_id", "demand_id"], "left").withColumn("near", F.coalesce("near", F.lit(float("inf"))))
    far = rows.groupBy("problem_id", "evidence_id").agg(F.max_by("demand_id", F.struct("near", "need", "demand_id")).alias("demand_id"))
    return far.join(base, ["evidence_id", "demand_id"]).select("problem_id", "site_id", F.col("access").alias("far"))


def policy_grid(problems: DataFrame, variants: DataFrame, policy_columns: Sequence[str]) -> DataFrame:
    """Every complete policy variant of every problem, with its own id and hash; equal hashes raise.

    ``variants`` holds problem_id, variant and the policy columns that replace the problem's own.
    """
    replaced = [c for c in policy_columns if c in variants.columns]
    rows = problems.drop(*replaced).join(variants.select("problem_id", "variant", *replaced), "problem_id")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(set(rows.columns) - {"variant"})]
    rows = rows.withColumn("problem_hash", F.sha2(F.concat_ws("|", *fields), 256))
    counts = rows.groupBy("problem_hash").agg(F.count(F.lit(1)).alias("_n"))
    raised = F.raise_error(F.lit("policy variants must differ")).cast("string")
    rows = rows.join(counts, "problem_hash").withColumn("problem_hash", F.when(F.col("_n") == 1, F.col("problem_hash")).otherwise(raised)).drop("_n")
    return rows.withColumnRenamed("problem_id", "base_problem_id").withColumn("problem_id", F.concat_ws("/", "base_problem_id", "variant"))
