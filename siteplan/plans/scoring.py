"""Bulk scoring of facility plans.

Plans are rows. Every metric is a grouped aggregate over joins keyed by plan, so thousands of plans
of thousands of problems are scored by the same job. Tables:

* ``problems``: problem_id, evidence_id, family, site_limit, new_site_limit, financial_budget,
  coverage_target, quantile, redundancy, equity, aggregation, minimum_spacing
* ``plans``: plan_id, problem_id; ``plan_sites``: plan_id, site_id, ord
* ``allocations``: plan_id, demand_id, site_id, amount; ``floors``: problem_id, group_name, floor
* evidence tables, see :class:`Evidence`.

Service and access tables are sparse: a missing service row is benefit 0, a missing access row is
unreachable. Nothing of size plans x demand x sites is built beyond the pairs that exist.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from siteplan.operators.ordered import weighted_quantile
from siteplan.session import cut_lineage, shuffle_buckets, written

# Comparison tolerance, key of an infeasible plan, problem families.
TOLERANCE = 1e-9
INFEASIBLE = -1e300
ACCESS_FAMILIES = ("weighted_p_median", "p_center", "quantile_access")
COVERAGE_FAMILIES = (
    "max_weighted_coverage",
    "min_cost_target_coverage",
    "equity_coverage",
    "incremental_coverage",
    "resilient_coverage",
)
CAPACITY_FAMILY = "capacitated_allocation"
FAMILIES = (*COVERAGE_FAMILIES, *ACCESS_FAMILIES, CAPACITY_FAMILY)

PROBLEM_SCHEMA = (
    "problem_id STRING, evidence_id STRING, family STRING, site_limit INT, new_site_limit INT, "
    "financial_budget DOUBLE, coverage_target DOUBLE, quantile DOUBLE, redundancy INT, equity STRING, "
    "aggregation STRING, minimum_spacing DOUBLE"
)
#: Selected sites per distinct site up to which plans meet pairs directly.
FEW_PLANS = 4
OVERALL = ""
NO_GROUP_PATTERN = "-"
DEMAND_KEYS = ["evidence_id", "scenario", "demand_id"]


@dataclass(frozen=True)
class Evidence:
    """Evidence tables, each keyed by ``evidence_id``.

    ``demand``: demand_id, need. ``sites``: site_id, opening_cost, capacity, eligible, existing, x, y.
    ``service``: scenario, demand_id, site_id, benefit. ``scenarios``: scenario, weight.
    ``access``: scenario, demand_id, site_id, access. ``multipliers``: scenario, demand_id, multiplier.
    ``failed``: scenario, site_id. ``groups``: group_name, demand_id, membership.
    """

    demand: DataFrame
    sites: DataFrame
    service: DataFrame
    scenarios: DataFrame
    access: DataFrame | None = None
    multipliers: DataFrame | None = None
    failed: DataFrame | None = None
    groups: DataFrame | None = None

    def settled(self) -> Evidence:
        """The same evidence written once to the checkpoint folder, for loops that score it many times."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return Evidence(**{n: cut_lineage(t) if t is not None else None for n, t in tables.items()})


def group_membership(df: DataFrame, demand_id: str, groups: dict[str, tuple[str, object | None]]) -> DataFrame:
    """Long membership table from ``{group: (column, match value or None)}``.

    With a match value membership is 0 or 1; otherwise the column is boolean or a fraction in [0, 1].
    """
    def membership(column: str, value) -> Column:
        if value is not None:
            return F.coalesce((F.col(column) == F.lit(value)).cast("double"), F.lit(0.0))
        share = F.col(column).cast("double")
        bad = F.raise_error(F.lit(f"membership in {column} must lie between 0 and 1")).cast("double")
        return F.when(share.between(0, 1), share).otherwise(bad)

    entries = F.array(*[
        F.struct(F.lit(name).alias("group_name"), membership(column, value).alias("membership"))
        for name, (column, value) in groups.items()
    ])
    keys = ["evidence_id"] if "evidence_id" in df.columns else []
    long = df.select(*keys, F.col(demand_id).alias("demand_id"), F.explode(entries).alias("e"))
    return long.select(*keys, "demand_id", "e.*").filter(F.col("membership") > 0)


def demand_weights(ev: Evidence) -> DataFrame:
    """One row per scenario and demand: scenario weight, base need and the id of its group pattern."""
    rows = ev.demand.select("evidence_id", "demand_id", F.col("need").cast("double").alias("need"))
    if ev.groups is None:
        rows = rows.withColumn("pattern", F.lit(NO_GROUP_PATTERN))
    else:
        own = _demand_patterns(ev).select("evidence_id", "demand_id", "pattern")
        rows = rows.join(own, ["evidence_id", "demand_id"], "left").withColumn("pattern", F.coalesce("pattern", F.lit(NO_GROUP_PATTERN)))
    rows = rows.join(ev.scenarios.select("evidence_id", "scenario"), "evidence_id")
    if ev.multipliers is None:
        return rows.withColumn("weight", F.col("need"))
    scaled = rows.join(ev.multipliers, ["evidence_id", "scenario", "demand_id"], "left")
    return scaled.withColumn("weight", F.col("need") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")


def _demand_patterns(ev: Evidence) -> DataFrame:
    entry = F.struct("group_name", F.col("membership").cast("double").alias("membership"))
    packed = ev.groups.groupBy("evidence_id", "demand_id").agg(F.sort_array(F.collect_list(entry)).alias("members"))
    return packed.withColumn("pattern", F.md5(F.to_json("members")))


def patterns(ev: Evidence) -> DataFrame:
    """``pattern, group_name, membership``: every distinct combination of group shares, with the whole.

    Sums are built per pattern first and spread over groups afterwards, so group figures cost a few
    rows per plan instead of several copies of every demand row.
    """
    whole = F.struct(F.lit(OVERALL).alias("group_name"), F.lit(1.0).alias("membership"))
    base = ev.scenarios.limit(1).select(F.lit(NO_GROUP_PATTERN).alias("pattern"), F.array(whole).alias("members"))
    if ev.groups is not None:
        known = _demand_patterns(ev).select("pattern", "members").distinct()
        base = base.unionByName(known.select("pattern", F.concat(F.array(whole), "members").alias("members")))
    return base.select("pattern", F.explode("members").alias("m")).select("pattern", "m.*")


def _by_group(sums: DataFrame, ev: Evidence, keys: list[str], names: list[str]) -> DataFrame:
    """Per-pattern sums to per-group sums."""
    spread = sums.join(patterns(ev), "pattern")
    return spread.groupBy(*keys, "group_name").agg(*[F.sum(F.col(n) * F.col("membership")).alias(n) for n in names])


def _totals(weights: DataFrame, ev: Evidence) -> DataFrame:
    sums = weights.groupBy("evidence_id", "scenario", "pattern").agg(
        F.sum("weight").alias("scenario_total"), F.sum("need").alias("demand"), F.count_if(F.col("weight") > 0).alias("_rows")
    )
    spread = sums.join(patterns(ev), "pattern")
    return spread.groupBy("evidence_id", "scenario", "group_name").agg(
        F.sum(F.col("scenario_total") * F.col("membership")).alias("scenario_total"),
        F.sum(F.col("demand") * F.col("membership")).alias("demand"),
        F.sum(F.when(F.col("membership") > 0, F.col("_rows")).otherwise(0)).alias("positive_rows"),
    )


def _keyed(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame) -> DataFrame:
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    return plan_sites.select("plan_id", "site_id").distinct().join(keys, "plan_id")


def _reach(selected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join selected sites with their demand pairs.

    The selected sites are written first, so that the planner copies them to the pairs where they are few; the pairs,
    by far the most rows, are then reduced where they arise and never moved one by one. Else a site that holds a large
    share of a side is split at run time by the adaptive skew join. Weights are joined to what the reduction leaves.
    """
    return written(selected).join(pairs, ["evidence_id", "site_id"])


def _weight_rows(weights: DataFrame) -> DataFrame:
    """One row per scenario, demand and pattern; ``_copies`` counts the rows it stands for."""
    return weights.groupBy("evidence_id", "scenario", "demand_id", "pattern").agg(
        F.max("weight").alias("weight"), F.max("need").alias("need"), F.count(F.lit(1)).alias("_copies")
    )


def _available(pairs: DataFrame, ev: Evidence) -> DataFrame:
    return pairs if ev.failed is None else pairs.join(ev.failed, ["evidence_id", "scenario", "site_id"], "left_anti")


def _plan_frame(plans: DataFrame, problems: DataFrame, totals: DataFrame, ev: Evidence) -> DataFrame:
    """Every plan x scenario x group with its totals and scenario weight (all small tables)."""
    rows = plans.join(problems.select("problem_id", "evidence_id", "aggregation"), "problem_id")
    rows = rows.join(ev.scenarios.withColumnRenamed("weight", "scenario_weight"), "evidence_id")
    return rows.join(totals, ["evidence_id", "scenario"])


def _fold_scenarios(value: str, worst=F.min) -> Column:
    """Expected (scenario-weighted) or worst-case value of a plan over its scenarios."""
    mean = F.try_divide(F.sum(F.col(value) * F.col("scenario_weight")), F.sum("scenario_weight"))
    # A flag, not the text, so that the aggregate stays a hash aggregate.
    return F.when(F.bool_or(F.coalesce(F.col("aggregation") == "worst_case", F.lit(False))), worst(value)).otherwise(mean)


def _mean(total: Column, weight: Column) -> Column:
    return F.when(weight > TOLERANCE, F.coalesce(total, F.lit(0.0)) / weight).otherwise(F.lit(0.0))


def coverage(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Best benefit per plan, scenario and demand over its available sites (rows above 0 only)."""
    pairs = _available(ev.service, ev).filter(F.col("benefit") > 0)
    best = _best_benefit(_keyed(plan_sites, plans, problems), pairs)
    return best.join(_weight_rows(demand_weights(ev)), DEMAND_KEYS).select("plan_id", "scenario", "demand_id", "pattern", "coverage", "weight")


def _best_benefit(selected: DataFrame, pairs: DataFrame) -> DataFrame:
    return _reach(selected.select("plan_id", "evidence_id", "site_id"), pairs).groupBy("plan_id", *DEMAND_KEYS).agg(F.max("benefit").alias("coverage"))


SIGNATURE = ["evidence_id", "scenario", "_h1", "_h2"]
#: Parts into which the signatures of one hub are dealt.
HUB_PARTS = 4


def signature_lists(ev: Evidence) -> DataFrame:
    """Demand added up by what reaches it: ``evidence_id, scenario, pattern, hub, sites, benefits, weight``.

    Demand rows of one scenario and group pattern that the same sites reach with the same benefits are one signature; its
    weight is the sum of its demand and ``hub`` the least of its sites. A row holds the sites of one demand row only, so
    that pairs are moved packed, and signatures of a hub are written side by side.
    """
    pairs = _available(ev.service, ev).filter((F.col("benefit") > 0) & F.col("site_id").isNotNull())
    packed = pairs.groupBy(*DEMAND_KEYS).agg(F.sort_array(F.collect_list(F.struct("site_id", "benefit"))).alias("_all"))
    # Of repeated pairs the best counts, which is the last in order.
    again = F.size(F.array_distinct("_all.site_id")) < F.size("_all")
    best = F.filter("_all", lambda e, i: ~F.get("_all", i + 1)["site_id"].eqNullSafe(e["site_id"]))
    packed = packed.select(*DEMAND_KEYS, F.when(again, best).otherwise(F.col("_all")).alias("_reach"))
    packed = packed.select(*DEMAND_KEYS, F.col("_reach.site_id").alias("sites"), F.col("_reach.benefit").alias("benefits"))
    rows = packed.join(demand_weights(ev), DEMAND_KEYS).withColumns(
        {"hub": F.get("sites", F.lit(0)), "_part": F.pmod(F.xxhash64("sites", "benefits"), F.lit(HUB_PARTS))}
    )
    rows = rows.repartition(shuffle_buckets(rows.sparkSession), "evidence_id", "hub", "_part")
    return rows.groupBy("evidence_id", "scenario", "pattern", "hub", "_part", "sites", "benefits").agg(F.sum("weight").alias("weight")).drop("_part")


def signatures(ev: Evidence) -> DataFrame:
    """One row per site of a signature: ``evidence_id, scenario, _h1, _h2, pattern, site_id, benefit, weight, sharing, hub``.

    A signature is told by two digests of its sites and benefits; ``sharing`` is the number of its sites.
    """
    told = [F.xxhash64("sites", "benefits").alias("_h1"), F.xxhash64("benefits", "sites", F.lit(1)).alias("_h2")]
    rows = signature_lists(ev).select("evidence_id", "scenario", *told, "pattern", "weight", F.size("sites").alias("sharing"), "hub", F.arrays_zip("sites", "benefits").alias("_r"))
    rows = rows.select("*", F.explode("_r").alias("_e")).withColumns({"site_id": F.col("_e.sites"), "benefit": F.col("_e.benefits")})
    return rows.select(*SIGNATURE, "pattern", "site_id", "benefit", "weight", "sharing", "hub")


#: Signatures and sets of one hub that one call works out at most on average, and the cells of its matrices.
HUB_SIGNATURES, HUB_SETS, CELLS = 4096, 65_536, 2**19


def _sums_of_sets(schema: pa.Schema, signs: pa.Table, sets: pa.Table) -> pa.Table:
    """What the sites of each set add to the best benefit of the signatures if all are added up, by scenario and pattern.

    The benefits of the sites that sets hold are laid out site by signature, signatures of one scenario and pattern side
    by side; sets of one size are taken together, in slices that bound the matrices.
    """
    if not signs.num_rows or not sets.num_rows:
        return schema.empty_table()
    scenario, pattern = (signs[c].combine_chunks().dictionary_encode() for c in ("scenario", "pattern"))
    kind = scenario.indices.to_numpy().astype(np.int64) * len(pattern.dictionary) + pattern.indices.to_numpy()
    kinds, kind = np.unique(kind, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    kind, signs = kind[order], signs.take(order)
    weight = pc.fill_null(signs["weight"], 0.0).to_numpy()

    lists = sets["_set"].combine_chunks()
    members, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    wanted = members.unique()
    members, starts = pc.index_in(members, value_set=wanted).to_numpy(), np.cumsum(sizes) - sizes
    held = signs["sites"].combine_chunks()
    place = pc.fill_null(pc.index_in(held.flatten(), value_set=wanted), -1).to_numpy()
    column = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())[place >= 0]
    benefit, place = signs["benefits"].combine_chunks().flatten().to_numpy()[place >= 0], place[place >= 0]

    sums = np.zeros((len(sizes), len(kinds)))
    width = max(1, CELLS // len(wanted))
    for low in range(0, len(kind), width):
        high = min(low + width, len(kind))
        entries = slice(*np.searchsorted(column, (low, high)))
        grid = np.zeros((len(wanted), high - low))
        grid[place[entries], column[entries] - low] = benefit[entries]
        found, first = np.unique(kind[low:high], return_index=True)
        for size in np.unique(sizes):
            alike = np.flatnonzero(sizes == size)
            for part in np.split(alike, range(max(1, CELLS // (high - low)), len(alike), max(1, CELLS // (high - low)))):
                total = best = grid[members[starts[part]]]
                for i in range(1, size):
                    other = grid[members[starts[part] + i]]
                    # Of two sites the lesser benefit is what they count twice.
                    again = np.fmin(total, other) if size == 2 else None
                    total, best = total + other, np.fmax(best, other)
                more = again if size == 2 else total - best
                sums[np.ix_(part, found)] += np.add.reduceat(more * weight[low:high], first, axis=1)
    row, col = np.nonzero(sums)
    of = kinds[col]
    out = {
        **{c: sets[c].take(row) for c in ("evidence_id", "hub", "_set")},
        "scenario": scenario.dictionary.take(of // len(pattern.dictionary)), "pattern": pattern.dictionary.take(of % len(pattern.dictionary)), "_twice": sums[row, col],
    }
    return pa.table([out[f.name] for f in schema], names=schema.names).cast(schema)


def _counted_twice(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """``evidence_id, hub, _set, scenario, pattern, _twice``: what each set of close sites counts twice at its hub.

    Signatures and sets of a hub meet as columns of one call; where a hub has many of them, they are dealt out in parts, and
    each part of the one meets each part of the other.
    """
    place = ["evidence_id", "hub"]
    count = lambda df, name, most: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    parts = written(count(shared, "_signs", HUB_SIGNATURES).join(count(sets, "_sets", HUB_SETS), place))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    signs = shared.join(parts, place).select(
        *place, F.pmod(F.xxhash64("sites", "benefits", "pattern", "scenario"), "_signs").alias("_i"), spread("_sets").alias("_j"),
        "scenario", "pattern", F.col("weight").cast("double").alias("weight"), "sites", F.col("benefits").cast("array<double>").alias("benefits"),
    )
    asked = sets.join(parts, place).select(*place, spread("_signs").alias("_i"), F.pmod(F.xxhash64("_set"), "_sets").alias("_j"), "_set")
    keys = [*place, "_i", "_j"]
    schema = StructType([*[f for f in sets.schema if f.name in (*place, "_set")], *[signs.schema[c] for c in ("scenario", "pattern")], StructField("_twice", DoubleType())])
    found = signs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(partial(_sums_of_sets, to_arrow_schema(schema)), schema)
    return found.groupBy(*place, "_set", "scenario", "pattern").agg(F.sum("_twice").alias("_twice"))


def covered_sums(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """``plan_id, scenario, pattern, _covered``: weight times best benefit, added up over the demand of each plan.

    No plan meets single demand rows. What one site adds is one number per site, scenario and pattern. Sites that share
    demand are counted twice by that only where a plan selects several of them: each signature names its least site as
    hub, and sites of a plan that have a hub in common are a set of close sites. What a set counts twice is worked out
    once for all plans that hold it, over the signatures of its hub alone, and taken off. Rows follow plans times sites
    and distinct sets times the signatures of their hubs.

    Where a site is in ``FEW_PLANS`` plans at most on average, the pairs themselves are no more than those rows: each
    plan then takes the best benefit per demand straight from the pairs.
    """
    listed = _keyed(plan_sites, plans, problems).groupBy("plan_id", "evidence_id", "site_id")
    selected = written(listed.agg(F.count(F.lit(1)).alias("_copies")))
    counts = selected.agg(F.sum("_copies").alias("n"), F.count_distinct("evidence_id", "site_id").alias("sites")).first()
    if (counts["n"] or 0) <= FEW_PLANS * counts["sites"]:
        best = _best_benefit(selected, _available(ev.service, ev).filter(F.col("benefit") > 0)).join(demand_weights(ev), DEMAND_KEYS)
        return best.groupBy("plan_id", "scenario", "pattern").agg(F.sum(F.col("coverage") * F.col("weight")).alias("_covered"))
    rows = written(signature_lists(ev).withColumn("_n", F.size("sites")))
    each = rows.select("evidence_id", "scenario", "pattern", "weight", "_n", F.explode(F.arrays_zip("sites", "benefits")).alias("_e"))
    worth = F.col("_e.benefits") * F.col("weight")
    per_site = each.groupBy("evidence_id", F.col("_e.sites").alias("site_id"), "scenario", "pattern").agg(
        F.sum(worth).alias("_w"), F.sum(F.when(F.col("_n") > 1, worth)).alias("_shared")
    )
    shared = rows.filter(F.col("_n") > 1)
    near = written(shared.select("evidence_id", "hub", F.explode("sites").alias("site_id")).distinct())
    # Hubs travel packed to their plans and are told apart there.
    packed = near.groupBy("evidence_id", "site_id").agg(F.collect_list("hub").alias("_hubs"))
    at_hubs = selected.join(packed, ["evidence_id", "site_id"]).repartition(shuffle_buckets(rows.sparkSession), "plan_id")
    place = ["plan_id", "evidence_id", "hub"]
    at_hubs = at_hubs.select("plan_id", "evidence_id", "site_id", F.explode("_hubs").alias("hub"))
    ends = at_hubs.groupBy(*place).agg(F.min("site_id").alias("_a"), F.max("site_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
    crowded = written(ends.filter(F.col("_n") > 1))
    two = crowded.filter(F.col("_n") == 2).select(*place, F.array("_a", "_b").alias("_set"))
    more = crowded.filter(F.col("_n") > 2).select(*place).join(selected, ["plan_id", "evidence_id"]).join(near, ["evidence_id", "hub", "site_id"], "left_semi")
    more = more.groupBy(*place).agg(F.sort_array(F.collect_list("site_id")).alias("_set"))
    close = written(two.unionByName(more))
    same = ["evidence_id", "hub", "_set"]
    twice = _counted_twice(shared, written(close.select(*same).distinct()))
    less = close.join(twice.filter(F.col("_twice") != 0), same).select("plan_id", "scenario", "pattern", (-F.col("_twice")).alias("_w"))
    # A plan row that comes several times counts as often, except for what its close sites share.
    many = close.select("plan_id", "evidence_id", F.explode("_set").alias("site_id")).join(selected.filter(F.col("_copies") > 1), ["plan_id", "evidence_id", "site_id"])
    many = many.distinct().join(per_site, ["evidence_id", "site_id"])
    less = less.unionByName(many.select("plan_id", "scenario", "pattern", ((1 - F.col("_copies")) * F.col("_shared")).alias("_w")))
    apart = selected.join(per_site, ["evidence_id", "site_id"]).select("plan_id", "scenario", "pattern", (F.col("_copies") * F.col("_w")).alias("_w"))
    return apart.unionByName(less).groupBy("plan_id", "scenario", "pattern").agg(F.sum("_w").alias("_covered"))


def coverage_by_scenario(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """``plan_id, scenario, group_name, coverage, scenario_total``; the empty group name is the whole demand."""
    sums = covered_sums(plan_sites, plans, problems, ev)
    sums = _by_group(sums, ev, ["plan_id", "scenario"], ["_covered"])
    frame = _plan_frame(plans, problems, _totals(demand_weights(ev), ev), ev)
    joined = frame.join(sums, ["plan_id", "scenario", "group_name"], "left")
    return joined.withColumn("coverage", _mean(F.col("_covered"), F.col("scenario_total"))).drop("_covered")


def coverage_metrics(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """``plan_id, group_name, coverage, demand`` folded over scenarios."""
    by_scenario = coverage_by_scenario(plan_sites, plans, problems, ev)
    return by_scenario.groupBy("plan_id", "group_name").agg(
        _fold_scenarios("coverage").alias("coverage"), F.max("demand").alias("demand")
    )


def access_by_scenario(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Nearest-site access per plan, scenario and group: average, maximum, weighted quantile, unserved rows."""
    weights = demand_weights(ev)
    finite = F.col("access") < float("inf")
    reached = _reach(_keyed(plan_sites, plans, problems), _available(ev.access, ev).filter(finite))
    nearest = reached.groupBy("plan_id", "problem_id", *DEMAND_KEYS).agg(F.min("access").alias("nearest"))
    # Sums and quantiles read it several times; the pairs are met once.
    nearest = written(nearest.join(_weight_rows(weights), DEMAND_KEYS))
    spread = nearest.filter("weight > 0").join(patterns(ev), "pattern").select(
        "plan_id", "problem_id", "scenario", "group_name", "nearest", (F.col("weight") * F.col("membership")).alias("w")
    ).filter(F.col("w") > 0)
    keys = ["plan_id", "scenario", "group_name"]
    sums = spread.groupBy(*keys).agg(
        F.sum(F.col("nearest") * F.col("w")).alias("_sum"),
        F.max("nearest").alias("maximum_access"),
        F.count(F.lit(1)).alias("served_rows"),
    )
    ranked = spread.join(problems.select("problem_id", F.coalesce("quantile", F.lit(0.5)).alias("_q")), "problem_id")
    quantiles = weighted_quantile(ranked, [*keys, "_q"], "nearest", "w", F.col("_q"), "quantile_access").drop("_q")
    frame = _plan_frame(plans, problems, _totals(weights, ev), ev)
    joined = frame.join(sums, keys, "left").join(quantiles, keys, "left")
    return joined.withColumns(
        {
            "average_access": _mean(F.col("_sum"), F.col("scenario_total")),
            "maximum_access": F.coalesce("maximum_access", F.lit(0.0)),
            "quantile_access": F.coalesce("quantile_access", F.lit(0.0)),
            "unserved_rows": F.col("positive_rows") - F.coalesce("served_rows", F.lit(0)),
        }
    ).drop("_sum", "served_rows")


def access_metrics(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """``plan_id, group_name, average_access, maximum_access, quantile_access, demand, unserved_rows``."""
    by_scenario = access_by_scenario(plan_sites, plans, problems, ev)
    return by_scenario.groupBy("plan_id", "group_name").agg(
        *[_fold_scenarios(m, F.max).alias(m) for m in ("average_access", "maximum_access", "quantile_access")],
        F.max("demand").alias("demand"),
        F.max("unserved_rows").alias("unserved_rows"),
    )


def resilience_by_site(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Coverage of each plan after losing each of its sites: ``plan_id, site_id, group_name, coverage``.

    The best and second-best benefit per demand give every loss at once: removing a site changes
    only the demand it serves best, by best minus second.
    """
    selected = _keyed(plan_sites, plans, problems)
    pairs = _available(ev.service, ev).filter(F.col("benefit") > 0)
    reached = _reach(selected.select("plan_id", "evidence_id", "site_id"), pairs)
    by_demand = Window.partitionBy("plan_id", *DEMAND_KEYS).orderBy(F.desc("benefit"), "site_id")
    top = reached.withColumn("_rank", F.row_number().over(by_demand)).filter("_rank <= 2")
    gaps = top.groupBy("plan_id", *DEMAND_KEYS).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("site_id"))).alias("site_id"),
        F.max("benefit").alias("_best"), F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("benefit"))), F.lit(0.0)).alias("_second"),
    )
    # A repeated demand row is served by the same site twice, so losing one leaves the other.
    gap = F.when(F.col("_copies") > 1, 0.0).otherwise(F.col("_best") - F.col("_second"))
    gaps = gaps.join(_weight_rows(demand_weights(ev)), DEMAND_KEYS).withColumn("gap", gap)
    losses = gaps.groupBy("plan_id", "site_id", "scenario", "pattern").agg(F.sum(F.col("gap") * F.col("weight")).alias("_loss"))
    losses = _by_group(losses, ev, ["plan_id", "site_id", "scenario"], ["_loss"])
    normal = coverage_by_scenario(plan_sites, plans, problems, ev)
    rows = normal.join(selected.select("plan_id", "site_id"), "plan_id")
    joined = rows.join(losses, ["plan_id", "site_id", "scenario", "group_name"], "left")
    left = joined.withColumn("coverage", F.col("coverage") - _mean(F.col("_loss"), F.col("scenario_total")))
    return left.groupBy("plan_id", "site_id", "group_name").agg(_fold_scenarios("coverage").alias("coverage"))


def redundancy_metrics(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Base-weighted share of demand with at least ``redundancy`` serving sites; failures are not applied."""
    weights = demand_weights(ev)
    selected = _keyed(plan_sites, plans, problems).join(problems.select("problem_id", "redundancy"), "problem_id")
    counts = _reach(selected, ev.service.filter(F.col("benefit") > 0)).groupBy("plan_id", *DEMAND_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("redundancy").alias("redundancy")
    )
    counts = counts.join(_weight_rows(weights), DEMAND_KEYS)
    enough = counts.filter(F.col("n") * F.col("_copies") >= F.col("redundancy"))
    sums = enough.groupBy("plan_id", "scenario", "pattern").agg(F.sum("need").alias("_sum"))
    sums = _by_group(sums, ev, ["plan_id", "scenario"], ["_sum"])
    frame = _plan_frame(plans, problems, _totals(weights, ev), ev)
    joined = frame.join(sums, ["plan_id", "scenario", "group_name"], "left")
    joined = joined.withColumn("redundant", _mean(F.col("_sum"), F.col("demand")))
    return joined.groupBy("plan_id", "group_name").agg(_fold_scenarios("redundant").alias("redundant_coverage"))


def resilience_metrics(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """``plan_id, group_name, one_failure_coverage, redundant_coverage``; a plan without sites gets 0."""
    worst = resilience_by_site(plan_sites, plans, problems, ev).groupBy("plan_id", "group_name").agg(
        F.min("coverage").alias("one_failure_coverage")
    )
    redundant = redundancy_metrics(plan_sites, plans, problems, ev)
    return redundant.join(worst, ["plan_id", "group_name"], "left").fillna(0.0, ["one_failure_coverage"])


def allocation_metrics(allocations: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """Served and unmet demand and amount-weighted access per plan and group.

    Access comes from the scenario rows named ``base`` when present, else from any one scenario.
    """
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    base = ev.access.groupBy("evidence_id", "demand_id", "site_id").agg(
        F.min_by("access", F.struct((F.col("scenario") != "base"), "scenario")).alias("access")
    )
    first = demand_weights(ev).groupBy("evidence_id", "demand_id", "pattern").agg(F.max("need").alias("need"))
    arcs = allocations.join(keys, "plan_id").join(first, ["evidence_id", "demand_id"])
    arcs = arcs.join(ev.sites.select("evidence_id", "site_id"), ["evidence_id", "site_id"], "left_semi")
    arcs = arcs.filter(~F.isnan("amount") & (F.abs("amount") < float("inf")))
    arcs = arcs.join(base, ["evidence_id", "demand_id", "site_id"], "left")
    sums = arcs.groupBy("plan_id", "pattern").agg(
        F.sum("amount").alias("served_demand"), F.sum(F.col("amount") * F.coalesce("access", F.lit(float("inf")))).alias("_access")
    )
    sums = _by_group(sums, ev, ["plan_id"], ["served_demand", "_access"])
    totals = _by_group(first.groupBy("evidence_id", "pattern").agg(F.sum("need").alias("demand")), ev, ["evidence_id"], ["demand"])
    joined = keys.join(totals, "evidence_id").join(sums, ["plan_id", "group_name"], "left")
    served = F.coalesce("served_demand", F.lit(0.0))
    return joined.select(
        "plan_id", "group_name", "demand", served.alias("served_demand"),
        F.try_divide(served, F.col("demand")).alias("coverage"),
        (F.col("demand") - served).alias("unmet_demand"),
        F.when(served != 0, F.col("_access") / served).otherwise(F.lit(0.0)).alias("average_access"),
    )


def site_totals(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    """One row per plan: counts and cost over its site list, in one join and one aggregate."""
    keys = plans.join(problems.select("problem_id", "evidence_id"), "problem_id")
    known = ev.sites.select("evidence_id", "site_id", "opening_cost", "eligible", "existing").withColumn("known", F.lit(True))
    rows = keys.join(plan_sites.select("plan_id", "site_id"), "plan_id", "left").join(known, ["evidence_id", "site_id"], "left")
    listed, found = F.col("site_id").isNotNull(), F.col("known").isNotNull()
    fresh = found & ~F.col("existing")
    sums = rows.groupBy("plan_id", "evidence_id").agg(
        F.count_if(listed).alias("listed"),
        F.count_distinct("site_id").alias("distinct_sites"),
        F.count_if(found).alias("site_count"),
        F.count_if(listed & ~found).alias("unknown_sites"),
        F.count_if(found & ~F.col("eligible")).alias("ineligible_sites"),
        F.count_if(fresh).alias("new_sites"),
        F.count_distinct(F.when(F.col("existing"), F.col("site_id"))).alias("kept_existing"),
        F.coalesce(F.sum(F.when(fresh, F.col("opening_cost"))), F.lit(0.0)).alias("opening_cost"),
    )
    standing = ev.sites.groupBy("evidence_id").agg(F.count_if("existing").alias("existing_sites"))
    return sums.join(standing, "evidence_id").drop("evidence_id")


def plan_cost(plan_sites: DataFrame, plans: DataFrame, problems: DataFrame, ev: Evidence) -> DataFrame:
    return site_totals(plan_sites, plans, problems, ev).select("plan_id", "opening_cost")


def _pick(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col("group_name") == group).drop("group_name")


def comparator_key(prefix_cost: str = "opening_cost") -> Column:
    """Higher-is-better key by family, as an array of doubles."""
    cost, family = -F.col(prefix_cost), F.col("family")
    access = -F.col("average_access")
    plain = F.when(F.col("equity") == "max_min", F.array("worst_group", "coverage", cost)).otherwise(
        F.array(F.col("coverage"), F.col("worst_group"), cost)
    )
    return (
        F.when(family == "min_cost_target_coverage", F.array(cost, F.col("coverage")))
        .when(family == "weighted_p_median", F.array(access, cost))
        .when(family == "p_center", F.array(-F.col("maximum_access"), access, cost))
        .when(family == "quantile_access", F.array(-F.col("quantile_access"), access, cost))
        .when(family == CAPACITY_FAMILY, F.array(F.col("coverage"), access, cost))
        .when(family == "resilient_coverage", F.array(F.col("one_failure_coverage"), F.col("redundant_coverage"), F.col("coverage"), cost))
        .otherwise(plain)
    )


def raw_objective() -> Column:
    """The family's own objective values by name."""
    family = F.col("family")

    def entry(*names: str) -> Column:
        return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n) for n in names]))

    median = F.map_from_arrays(F.array(F.lit("weighted_average_access")), F.array("average_access"))
    fair = F.map_from_arrays(F.array(F.lit("worst_group_coverage")), F.array("worst_group"))
    return (
        F.when(family == "weighted_p_median", median)
        .when(family == "p_center", entry("maximum_access"))
        .when(family == "quantile_access", entry("quantile_access", "quantile"))
        .when(family == "min_cost_target_coverage", entry("opening_cost", "coverage"))
        .when(family == CAPACITY_FAMILY, entry("served_demand", "unmet_demand", "average_access"))
        .when(family == "resilient_coverage", entry("one_failure_coverage", "redundant_coverage"))
        .when(F.col("equity") == "max_min", fair)
        .otherwise(entry("coverage"))
    )


def compare_keys(left: Column, right: Column) -> Column:
    """1 when left is better, -1 when worse, 0 when every element is within the tolerance."""
    signs = F.zip_with(
        left, right, lambda a, b: F.when(a > b + TOLERANCE, 1).when(a < b - TOLERANCE, -1).otherwise(0)
    )
    return F.aggregate(signs, F.lit(0), lambda acc, s: F.when(acc != 0, acc).otherwise(s))


def compare(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Scored plans side by side: ``comparison`` is 1, 0 or -1; different problems raise.

    Inputs hold ``problem_hash, feasible, comparator`` beside the join columns.
    """
    fields = ("problem_hash", "feasible", "comparator")
    a = left.select(*on, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = right.select(*on, *[F.col(f).alias(f"_b_{f}") for f in fields])
    better = F.when(F.col("_a_feasible"), 1).otherwise(-1)
    by_key = compare_keys(F.col("_a_comparator"), F.col("_b_comparator"))
    outcome = F.when(F.col("_a_feasible") != F.col("_b_feasible"), better).otherwise(by_key)
    clash = F.raise_error(F.lit("cannot compare plans of different problems")).cast("int")
    mixed = F.col("_a_problem_hash") != F.col("_b_problem_hash")
    return a.join(b, on).select(*on, F.when(mixed, clash).otherwise(outcome).alias("comparison"))


def best_plan(scores: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Best feasible plan per key, first in order among equals.

    The pairwise tolerance is not transitive; keys are rounded to the same 9 digits instead.
    """
    rounded = F.transform("comparator", lambda v: F.round(v, 9))
    rank = F.struct(F.col("feasible"), rounded, -F.col(ordinal))
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*scores.columns), rank).alias("_b")).select("_b.*").filter("feasible")
