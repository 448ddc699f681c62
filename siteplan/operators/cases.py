"""Evaluation cases: name lookup, exact small coverage problems, grading, regional catalogs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.functions.arrays import choose, combination_at, pair_at
from siteplan.functions.text import match_score
from siteplan.operators.ordered import positions, running
from siteplan.session import cut_lineage, shuffle_buckets

# Fixed values of the name search: least score kept, least score resolved, least lead over the second.
KEEP_SCORE = 0.35
RESOLVE_SCORE = 0.72
RESOLVE_MARGIN = 0.03
RADIUS_SLACK = 1e-9
SALT = 8


def search_names(queries: DataFrame, places: DataFrame, limit: int = 5) -> DataFrame:
    """Ranked matches per query inside its case: ``case_id, query, rank, location_id, name, score``.

    ``queries``: case_id, query, normalized; ``places``: case_id, location_id, name, normalized. Equal
    queries are scored once, pairs whose lengths alone exclude the kept score are never scored, and a
    case's queries are spread by a salt.
    """
    asked = queries.filter(F.col("normalized") != "").select("case_id", F.col("normalized").alias("q")).distinct()
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("q"), F.lit(SALT)).cast("int"))
    known = places.select("case_id", F.col("normalized").alias("n")).distinct()
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    lengths = F.least(F.length("q"), F.length("n")) * 2.0 >= (F.length("q") + F.length("n")) * KEEP_SCORE
    contained = F.contains(F.col("n"), F.col("q")) | F.contains(F.col("q"), F.col("n"))
    pairs = asked.join(known, ["case_id", "_salt"]).filter(lengths | contained)
    scored = pairs.withColumn("score", match_score("q", "n")).filter(F.col("score") >= KEEP_SCORE)
    named = scored.join(
        places.select("case_id", F.col("normalized").alias("n"), "location_id", "name"), ["case_id", "n"]
    ).withColumn("_down", -F.col("score"))
    ranked = positions(named, ["case_id", "q"], ["_down", "name", "location_id"], name="rank").filter(F.col("rank") <= limit)
    answers = ranked.select("case_id", "q", "rank", "location_id", "name", "score")
    back = queries.select("case_id", "query", F.col("normalized").alias("q"))
    return back.join(answers, ["case_id", "q"]).drop("q")


def resolve_names(queries: DataFrame, places: DataFrame) -> DataFrame:
    """One row per query: ``status`` resolved, ambiguous, unknown or repeated, and the location.

    An id hit wins, then an exact name, then the best score when it is high enough and clearly ahead.
    """
    ids = places.select("case_id", F.col("location_id").alias("query"), F.col("location_id").alias("by_id"))
    exact = places.groupBy("case_id", "normalized").agg(F.max("location_id").alias("by_name"))
    base = queries.join(ids, ["case_id", "query"], "left").join(exact, ["case_id", "normalized"], "left")
    loose = base.filter(F.col("by_id").isNull() & F.col("by_name").isNull())
    top = search_names(loose.select("case_id", "query", "normalized"), places, 2)
    best = top.groupBy("case_id", "query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col("location_id"))).alias("by_score"),
    )
    joined = base.join(best, ["case_id", "query"], "left")
    sure = F.coalesce("by_id", "by_name")
    low = F.coalesce(F.col("first_score") < RESOLVE_SCORE, F.lit(True))
    close = F.coalesce(F.abs(F.col("first_score") - F.col("second_score")) < RESOLVE_MARGIN, F.lit(False))
    status = F.when(sure.isNotNull(), "resolved").when(low, "unknown").when(close, "ambiguous").otherwise("resolved")
    rows = joined.select(
        "case_id", "query", "ord", status.alias("status"), F.when(status == "resolved", F.coalesce(sure, F.col("by_score"))).alias("location_id")
    )
    uses = rows.filter(F.col("location_id").isNotNull()).groupBy("case_id", "location_id").agg(F.min("ord").alias("_first"))
    checked = rows.join(uses, ["case_id", "location_id"], "left")
    again = F.col("_first").isNotNull() & (F.col("ord") > F.col("_first"))
    return checked.withColumn("status", F.when(again, "repeated").otherwise(F.col("status"))).drop("_first")


def _sphere(longitude: str, latitude: str) -> list[Column]:
    """The point on the unit sphere, worked out once per place."""
    lam, phi = F.radians(longitude), F.radians(latitude)
    return [(F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z")]


def _within(a: Column, b: Column, radius: str) -> Column:
    """Whether two places (longitude, latitude, x, y, z) are within the radius.

    Half the square of the chord tells most places apart; the distance is worked out within a billionth of the radius.
    """
    gap = F.lit(1.0) - (a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])
    angle = F.least(F.greatest(F.col(radius) + RADIUS_SLACK, F.lit(0.0)) / (2 * geo.EARTH_RADIUS_KM), F.lit(math.pi / 2))
    limit = F.sin(angle) * F.sin(angle) * 2
    km = geo.haversine(a["longitude"], a["latitude"], b["longitude"], b["latitude"])
    surely, never = gap <= limit * (1 - 1e-9) - 1e-13, gap > limit * (1 + 1e-9) + 1e-13
    return surely | (~never & (km <= F.col(radius) + RADIUS_SLACK))


def _covers(places: DataFrame, radius: str) -> DataFrame:
    """Per case: population array, and per place the indices of the places within the radius.

    A case is one row holding its own places, as its subsets are enumerated.
    """
    entry = F.struct("ord", "longitude", "latitude", F.coalesce("population", F.lit(0)).cast("bigint").alias("population"), "name", *_sphere("longitude", "latitude"))
    packed = places.groupBy("case_id", radius).agg(F.sort_array(F.collect_list(entry)).alias("p"))
    # Cases are small rows with much work each: a fixed number of partitions keeps all cores busy.
    packed = packed.repartition(shuffle_buckets(places.sparkSession), "case_id")

    def reach(center: Column) -> Column:
        return F.array_compact(F.transform(F.col("p"), lambda d, i: F.when(_within(center, d, radius), i)))

    return packed.select(
        "case_id", F.size("p").alias("n"), F.transform("p", lambda e: e["population"]).alias("population"),
        F.transform("p", lambda e: e["name"]).alias("names"), F.transform("p", reach).alias("reaches"),
    )


def _subsets(cases: DataFrame, size: Column) -> DataFrame:
    """Every ``size``-subset of each case's places as an ascending index array, addressed by its number."""
    count = choose(F.col("n"), size).cast("bigint")
    indices = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    at = F.col("_subset")
    some = F.transform(combination_at(F.col("n"), size, at), lambda i: i.cast("int"))
    chosen = F.when(size == 1, F.array(at.cast("int"))).when(size == 2, F.array(*[i.cast("int") for i in pair_at(at, F.col("n"))])).otherwise(some)
    return cases.withColumn("_subset", F.explode(indices)).withColumn("chosen", chosen).drop("_subset")


def _subsets_of_size(cases: DataFrame, size: int) -> DataFrame:
    """``_subsets`` of one size for all cases: each subset is the one before it and a later place, no number is decoded."""
    rows = cases.withColumn("chosen", F.array().cast("array<int>"))
    for taken in range(size):
        first = F.element_at("chosen", -1) + 1 if taken else F.lit(0)
        last = F.col("n") - (size - taken)
        rows = rows.withColumn("_next", F.explode(F.when(first <= last, F.sequence(first, last))))
        rows = rows.withColumn("chosen", F.concat("chosen", F.array("_next"))).drop("_next")
    return rows


def _covered(rows: DataFrame) -> DataFrame:
    several = F.array_distinct(F.flatten(F.transform("chosen", lambda i: F.get("reaches", i))))
    reached = F.when(F.size("chosen") == 1, F.get("reaches", F.get("chosen", F.lit(0)))).otherwise(several)
    people = F.aggregate(reached, F.lit(0).cast("bigint"), lambda total, i: total + F.get("population", i))
    # A generated column: a test of it is not pushed down, where the subset would be worked out once more for each use.
    return rows.withColumn("people_covered", F.explode(F.array(people)))


def solve_max_coverage(places: DataFrame, cases: DataFrame) -> DataFrame:
    """Exact best ``centers`` places per case: first optimum in combination order and the number of optima.

    ``cases``: case_id, centers, radius_km; ``places``: case_id, ord, name, longitude, latitude, population.
    """
    size = F.when(F.col("centers").between(1, F.col("n")), F.col("centers")).otherwise(
        F.raise_error(F.lit("centers must lie between 1 and the number of places")).cast("int")
    )
    base = _covers(places.join(cases.select("case_id", "radius_km"), "case_id"), "radius_km")
    base = base.join(cases.select("case_id", "centers"), "case_id").withColumn("centers", size)
    scored = _covered(_subsets(base, F.col("centers"))).select("case_id", "people_covered", "chosen")
    # One aggregate keeps every value, how often it occurs, and its first combination.
    by_value = scored.groupBy("case_id", "people_covered").agg(
        F.count(F.lit(1)).alias("optimal_solution_count"), F.min("chosen").alias("chosen")
    )
    best = by_value.groupBy("case_id").agg(F.max_by(F.struct("people_covered", "optimal_solution_count", "chosen"), "people_covered").alias("b"))
    named = best.join(base.select("case_id", "names"), "case_id")
    return named.select(
        "case_id", "b.people_covered", "b.optimal_solution_count", F.transform("b.chosen", lambda i: F.get("names", i)).alias("center_locations")
    )


def solve_minimum_facility(places: DataFrame, cases: DataFrame) -> DataFrame:
    """Fewest places that reach the target share of population; first optimum and number of optima.

    ``cases``: case_id, target_percent, radius_km. Sizes are tried in turn, each only for the
    cases not solved yet. The people covered are those of
    the first optimum.
    """
    base = _covers(places.join(cases.select("case_id", "radius_km"), "case_id"), "radius_km")
    total = F.aggregate("population", F.lit(0).cast("bigint"), lambda a, b: a + b)
    base = cut_lineage(base.join(cases.select("case_id", "target_percent"), "case_id").withColumn(
        "target_population", F.ceil(total * F.col("target_percent") / 100).cast("bigint")
    ))

    def first_optima(tried: DataFrame) -> DataFrame:
        enough = _covered(tried).filter(F.col("people_covered") >= F.col("target_population"))
        by_size = enough.groupBy("case_id", F.size("chosen").alias("minimum_centers")).agg(
            F.count(F.lit(1)).alias("optimal_solution_count"), F.min(F.struct("chosen", "people_covered")).alias("b")
        )
        return by_size.groupBy("case_id").agg(
            F.min("minimum_centers").alias("minimum_centers"), F.min_by(F.struct("optimal_solution_count", "b"), "minimum_centers").alias("f")
        )

    pending = base
    solved = first_optima(base.limit(0).withColumn("chosen", F.array().cast("array<int>")))
    largest = pending.agg(F.max("n")).first()[0] or 0
    for size in range(1, largest + 1):
        found = cut_lineage(first_optima(_subsets_of_size(pending, size)))
        solved = solved.unionByName(found)
        pending = cut_lineage(pending.join(found.select("case_id"), "case_id", "left_anti"))
        if pending.isEmpty():
            break
    named = solved.join(base.select("case_id", "names", "target_population"), "case_id")
    return named.select(
        "case_id", "minimum_centers", F.col("f.b.people_covered").alias("people_covered"), "target_population",
        F.col("f.optimal_solution_count").alias("optimal_solution_count"),
        F.transform("f.b.chosen", lambda i: F.get("names", i)).alias("center_locations"),
    )


def covered_population(places: DataFrame, chosen: DataFrame, radius: str = "radius_km") -> DataFrame:
    """People within the radius of any chosen place of their case, each place counted once.

    ``places``: case_id, ord, longitude, latitude, population, radius; ``chosen``: case_id, ord.
    """
    centers = places.join(chosen.select("case_id", "ord").distinct(), ["case_id", "ord"], "left_semi").select(
        "case_id", "longitude", "latitude", *_sphere("longitude", "latitude")
    )
    lists = centers.groupBy("case_id").agg(F.collect_list(F.struct("longitude", "latitude", "x", "y", "z")).alias("centers"))
    near = F.exists("centers", lambda c: _within(c, F.col("_here"), radius))
    here = F.struct("longitude", "latitude", *_sphere("longitude", "latitude"))
    joined = places.withColumn("_here", here).join(lists, "case_id", "left")
    hit = F.coalesce(near, F.lit(False))
    population = F.coalesce("population", F.lit(0)).cast("bigint")
    return joined.groupBy("case_id").agg(
        F.coalesce(F.sum(F.when(hit, population)), F.lit(0)).alias("people_covered"), F.sum(population).alias("total_population")
    )


def target_reached(covered: DataFrame, targets: DataFrame) -> DataFrame:
    """Feasibility of covered populations against ``target_percent`` per case."""
    joined = covered.join(targets, "case_id")
    goal = F.ceil(F.col("total_population") * F.col("target_percent") / 100).cast("bigint")
    return joined.withColumn("target_population", goal).withColumn("target_reached", F.col("people_covered") >= goal)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def matches_any(selected: Column, solutions: Column) -> Column:
    """Whether the selection equals one of the accepted solutions as a set."""
    return F.exists(solutions, lambda option: same_set(option, selected))


def grade(predictions: DataFrame, cases: DataFrame, tolerance_km: float) -> DataFrame:
    """``correct`` and ``objective_correct`` per prediction.

    ``cases``: case_id, kind, expected_value, solutions ARRAY<ARRAY<STRING>>, max_centers;
    ``predictions``: case_id, value, selected ARRAY<STRING>. The value is people covered, number of
    centers or tour kilometres. A case without a prediction is wrong.
    """
    joined = cases.join(predictions, "case_id", "left")
    tour = F.abs(F.col("value") - F.col("expected_value")) <= tolerance_km
    equal = F.col("value") == F.col("expected_value")
    exact = equal & F.coalesce(matches_any(F.col("selected"), F.col("solutions")), F.lit(False))
    correct = F.coalesce(F.when(F.col("kind") == "tsp", tour).otherwise(exact), F.lit(False))
    within = equal & (F.size("selected") <= F.coalesce("max_centers", F.lit(0)))
    objective = F.when(F.col("kind") == "max_coverage", F.coalesce(within, F.lit(False))).otherwise(correct)
    return joined.select(*[c for c in joined.columns if c not in ("solutions",)], correct.alias("correct"), objective.alias("objective_correct"))


def grader_timeline(candidates: DataFrame, keys: list[str], order: str, baseline: str = "baseline") -> DataFrame:
    """Incumbents of the dataset grader: strict improvements, and plans equal to a still-standing baseline.

    ``candidates``: keys, order, source, comparator.
    """
    state = F.struct("comparator", (F.col("source") != baseline).cast("int").alias("own"))
    scanned = running(candidates, keys, [order], {"_best": ("max", state)}, inclusive=False)
    equal = F.col("comparator") == F.col("_best.comparator")
    better = F.col("_best").isNull() | (F.col("comparator") > F.col("_best.comparator"))
    return scanned.filter(better | (equal & (F.col("_best.own") == 0) & (F.col("source") != baseline))).drop("_best")


def region_catalog(places: DataFrame) -> DataFrame:
    """First place per region and normalised name; differing coordinates raise."""
    grouped = places.groupBy("region", "normalized").agg(
        F.min_by(F.struct("location_id", "name", "latitude", "longitude"), F.struct("case_id", "ord")).alias("_p"),
        F.min(F.struct("latitude", "longitude")).alias("_low"), F.max(F.struct("latitude", "longitude")).alias("_high"),
        F.min(F.struct("case_id", "ord")).alias("first_seen"),
    )
    bad = F.raise_error(F.concat(F.lit("coordinates vary within a region for "), F.col("normalized"))).cast("boolean")
    sound = F.when(F.col("_low") == F.col("_high"), True).otherwise(bad)
    return grouped.filter(sound).select("region", "normalized", "_p.*", "first_seen")


def select_cases(cases: DataFrame, order: list[str], regions: list[str] | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """Region filter without regard to case, then a slice of the given order."""
    kept = cases
    if regions:
        kept = kept.filter(F.lower("region").isin(*[r.lower() for r in regions]))
    ordered = kept.orderBy(*order).offset(start)
    return ordered if limit is None else ordered.limit(limit)


def selection_digest(cases: DataFrame, keys: list[str], record_id: str, order: str, max_records: int = 1_000_000) -> DataFrame:
    """SHA-256 of the JSON array of ordered record ids per key (an experiment's slice).

    The digest is defined on one text, so larger selections raise; use ``tree_digest`` for them.
    """
    counts = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.raise_error(F.lit("selection too large for one digest")).cast("boolean")
    small = counts.filter(F.when(F.col("_n") <= max_records, True).otherwise(bad))
    # The size test comes first: a group is collected only once it is known to be small.
    rows = cases.join(small, keys)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, record_id))), lambda e: e[record_id].cast("string"))
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(ids), 256).alias("selection_digest"), F.first("_n").alias("records"))


def tree_digest(cases: DataFrame, keys: list[str], record_id: str, order: str, block: int = 4096) -> DataFrame:
    """Digest of digests over blocks of ``block`` ordered ids, for selections of any size."""
    placed = positions(cases, keys, [order], name="_p")
    level = placed.select(*keys, F.col("_p").alias("_at"), F.sha2(F.col(record_id).cast("string"), 256).alias("_d"))
    # The levels follow the longest selection, so that one digest is left for every key.
    longest = placed.agg(F.max("_p")).first()[0] or 1
    levels = 1
    while block**levels < longest:
        levels += 1
    for _ in range(max(4, levels)):
        level = level.withColumn("_b", F.floor((F.col("_at") - 1) / block) + 1).groupBy(*keys, "_b").agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda e: e["_d"]), ""), 256).alias("_d")
        ).withColumnRenamed("_b", "_at")
    return level.filter(F.col("_at") == 1).select(*keys, F.col("_d").alias("tree_digest"))
