"""Scoring, validity and search of facility plans built from orders and suppliers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siteplan.functions.text import descending_code_points
from siteplan.operators import evidence as tables
from siteplan.operators import quality
from siteplan.plans import scorecards, search, validation
from siteplan.plans import scoring as s
from siteplan.workloads import query
from siteplan.workloads.base import DEMAND, REACH_KM, SERVICE_KM, SITE, demand, od_pairs, pairs_sql, site, table, with_sql



def _world(df):
    return df.select(F.lit("world").alias("evidence_id"), "*")


def world_evidence(spark, sf, km=SERVICE_KM, scale=400.0, access=False):
    """All customers and suppliers as one evidence set: a base and a storm scenario, segments as groups."""
    people = _world(demand(spark, sf))
    sites = _world(site(spark, sf)).withColumnsRenamed({"lon": "x", "lat": "y"})
    pairs = _world(od_pairs(spark, sf, km))
    names = F.array(F.lit("base"), F.lit("storm"))
    per_scenario = pairs.withColumn("scenario", F.explode(names))
    service = per_scenario.select("evidence_id", "scenario", "demand_id", "site_id", F.exp(-F.col("km") / scale).alias("benefit"))
    reach = per_scenario.select(
        "evidence_id", "scenario", "demand_id", "site_id",
        (F.col("km") * F.when(F.col("scenario") == "storm", 1.5).otherwise(1.0)).alias("access"),
    )
    scenarios = _world(spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("base").alias("scenario"), F.lit(0.7).alias("weight")),
        F.struct(F.lit("storm").alias("scenario"), F.lit(0.3).alias("weight")),
    )).alias("e")).select("e.*"))
    multipliers = people.filter(F.col("demand_id") % 3 == 0).select(
        "evidence_id", F.lit("storm").alias("scenario"), "demand_id", F.lit(2.0).alias("multiplier")
    )
    failed = sites.filter(F.col("site_id") % 9 == 0).select("evidence_id", F.lit("storm").alias("scenario"), "site_id")
    groups = people.select("evidence_id", F.col("grp").alias("group_name"), "demand_id", F.lit(1.0).alias("membership"))
    return s.Evidence(people, sites, service, scenarios, reach if access else None, multipliers, failed, groups)


WEIGHT_SQL = """weighted AS (
  SELECT d.demand_id, d.grp, d.need, v.scenario, v.sw, d.need * CASE WHEN v.scenario = 'storm' AND d.demand_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS w
  FROM demand d CROSS JOIN (VALUES ('base', 0.7::DOUBLE), ('storm', 0.3::DOUBLE)) v(scenario, sw)),
total AS (SELECT scenario, sum(w) AS t FROM weighted GROUP BY 1)"""
FAILED_SQL = "NOT (v.scenario = 'storm' AND p.site_id % 9 = 0)"
ORDER_SITES_SQL = """psite AS (SELECT DISTINCT l_orderkey AS plan_id, l_suppkey AS site_id FROM lineitem)"""


def problems_table(spark, sf, **policy):
    """One problem per order priority with the given policy columns."""
    priorities = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("problem_id")).distinct()
    kinds = dict(f.split(" ") for f in s.PROBLEM_SCHEMA.split(", "))
    columns = {"evidence_id": F.lit("world"), "family": F.lit("max_weighted_coverage"), "aggregation": F.lit("expected"), **policy}
    return priorities.select(
        "problem_id", *[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items() if n != "problem_id"]
    )


def order_plans(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderpriority").alias("problem_id"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_suppkey").alias("site_id")).distinct()
    return orders, lines


def region_plans(spark, sf):
    """One plan per region: the suppliers of its nations."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("plan_id"))
    rows = site(spark, sf).join(nations, "nation").select("plan_id", "site_id")
    plans = table(spark, sf, "region").select(F.col("r_regionkey").alias("plan_id"), F.lit("p").alias("problem_id"))
    return plans, rows


def one_problem(spark, sf, **policy):
    kinds = dict(f.split(" ") for f in s.PROBLEM_SCHEMA.split(", "))
    columns = {"problem_id": F.lit("p"), "evidence_id": F.lit("world"), "family": F.lit("max_weighted_coverage"), "aggregation": F.lit("expected"), **policy}
    return spark.range(1).select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


REGION_SITES_SQL = "psite AS (SELECT n.n_regionkey AS plan_id, s.site_id FROM site s JOIN nation n ON n.n_nationkey = s.nation)"


@query(
    "order_plan_coverage",
    with_sql(
        DEMAND, SITE, pairs_sql(SERVICE_KM), WEIGHT_SQL, ORDER_SITES_SQL,
        f"""cov AS (SELECT p.plan_id, v.scenario, q.demand_id, max(exp(-q.km / 400)) AS c FROM psite p JOIN pair q USING (site_id)
  CROSS JOIN (VALUES ('base'), ('storm')) v(scenario) WHERE {FAILED_SQL} GROUP BY ALL)""",
        "scen AS (SELECT c.plan_id, c.scenario, sum(c.c * w.w) AS s FROM cov c JOIN weighted w USING (scenario, demand_id) GROUP BY ALL)",
        """full_ AS (SELECT o.o_orderkey AS plan_id, o.o_orderpriority AS pr, v.scenario, v.sw, coalesce(s.s, 0) / t.t AS c FROM orders o
  CROSS JOIN (VALUES ('base', 0.7::DOUBLE), ('storm', 0.3::DOUBLE)) v(scenario, sw) JOIN total t USING (scenario)
  LEFT JOIN scen s ON s.plan_id = o.o_orderkey AND s.scenario = v.scenario)""",
        body="SELECT plan_id, round(CASE WHEN pr < '3' THEN sum(c * sw) / sum(sw) ELSE min(c) END, 9) AS coverage FROM full_ GROUP BY plan_id, pr",
    ),
)
def order_plan_coverage(spark, sf):
    """Every order as a plan of its suppliers, scored over two scenarios."""
    mode = F.when(F.col("problem_id") < "3", "expected").otherwise("worst_case")
    plans, rows = order_plans(spark, sf)
    # Only the whole demand is reported, so no group shares travel with the pairs.
    ev = replace(world_evidence(spark, sf), groups=None)
    metrics = s.coverage_metrics(rows, plans, problems_table(spark, sf, aggregation=mode), ev)
    return metrics.filter(F.col("group_name") == "").select("plan_id", F.round("coverage", 9).alias("coverage"))


@query(
    "region_plan_groups",
    with_sql(
        DEMAND, SITE, pairs_sql(SERVICE_KM), WEIGHT_SQL, REGION_SITES_SQL,
        f"""cov AS (SELECT p.plan_id, v.scenario, q.demand_id, max(exp(-q.km / 400)) AS c FROM psite p JOIN pair q USING (site_id)
  CROSS JOIN (VALUES ('base'), ('storm')) v(scenario) WHERE {FAILED_SQL} GROUP BY ALL)""",
        "per AS (SELECT r.r_regionkey AS plan_id, w.*, coalesce(c.c, 0) AS c FROM region r CROSS JOIN weighted w LEFT JOIN cov c ON c.plan_id = r.r_regionkey AND c.scenario = w.scenario AND c.demand_id = w.demand_id)",
        "g AS (SELECT plan_id, grp AS group_name, scenario, sw, sum(c * w) / sum(w) AS c, sum(need) AS d FROM per GROUP BY ALL)",
        body="SELECT plan_id, group_name, round(sum(c * sw) / sum(sw), 9) AS coverage, round(max(d), 4) AS demand FROM g GROUP BY ALL",
    ),
)
def region_plan_groups(spark, sf):
    plans, rows = region_plans(spark, sf)
    metrics = s.coverage_metrics(rows, plans, one_problem(spark, sf), world_evidence(spark, sf))
    return metrics.filter(F.col("group_name") != "").select(
        "plan_id", "group_name", F.round("coverage", 9).alias("coverage"), F.round("demand", 4).alias("demand")
    )


@query(
    "region_plan_access",
    with_sql(
        DEMAND, SITE, pairs_sql(REACH_KM), WEIGHT_SQL, REGION_SITES_SQL,
        f"""near AS (SELECT p.plan_id, v.scenario, q.demand_id, min(q.km * v.f) AS a FROM psite p JOIN pair q USING (site_id)
  CROSS JOIN (VALUES ('base', 1.0::DOUBLE), ('storm', 1.5::DOUBLE)) v(scenario, f) WHERE {FAILED_SQL} GROUP BY ALL)""",
        "rows_ AS (SELECT n.plan_id, n.scenario, n.a, w.w FROM near n JOIN weighted w USING (scenario, demand_id) WHERE w.w > 0)",
        "cum AS (SELECT *, sum(w) OVER (PARTITION BY plan_id, scenario ORDER BY a) AS c, sum(w) OVER (PARTITION BY plan_id, scenario) AS t FROM rows_)",
        "q AS (SELECT plan_id, scenario, min(a) FILTER (WHERE c >= 0.9 * t) AS qa FROM cum GROUP BY ALL)",
        "agg AS (SELECT plan_id, scenario, sum(a * w) AS s, max(a) AS m, count(*) AS n FROM rows_ GROUP BY ALL)",
        "pos AS (SELECT scenario, count(*) FILTER (WHERE w > 0) AS n FROM weighted GROUP BY 1)",
        """f AS (SELECT a.plan_id, a.scenario, a.s / t.t AS av, a.m, q.qa, pos.n - a.n AS u, CASE a.scenario WHEN 'base' THEN 0.7 ELSE 0.3 END::DOUBLE AS sw
  FROM agg a JOIN q USING (plan_id, scenario) JOIN total t USING (scenario) JOIN pos USING (scenario))""",
        body="""SELECT plan_id, round(sum(av * sw) / sum(sw), 6) AS average_access, round(sum(m * sw) / sum(sw), 6) AS maximum_access,
  round(sum(qa * sw) / sum(sw), 6) AS quantile_access, max(u) AS unserved_rows FROM f GROUP BY plan_id""",
    ),
)
def region_plan_access(spark, sf):
    """Nearest-site access of each region's suppliers: mean, maximum and 90% weighted quantile."""
    plans, rows = region_plans(spark, sf)
    problem = one_problem(spark, sf, family=F.lit("weighted_p_median"), quantile=F.lit(0.9))
    found = s.access_metrics(rows, plans, problem, world_evidence(spark, sf, REACH_KM, access=True)).filter(F.col("group_name") == "")
    return found.select(
        "plan_id", *[F.round(c, 6).alias(c) for c in ("average_access", "maximum_access", "quantile_access")], "unserved_rows"
    )


LOSS_SQL = f"""reach AS (SELECT p.plan_id, v.scenario, q.demand_id, p.site_id, exp(-q.km / 400) AS b FROM psite p JOIN pair q USING (site_id)
  CROSS JOIN (VALUES ('base'), ('storm')) v(scenario) WHERE {FAILED_SQL}),
alone AS (SELECT f.plan_id, f.site_id AS lost, v.scenario, v.sw,
    coalesce((SELECT sum(x.c * w.w) FROM (SELECT r.demand_id, max(r.b) AS c FROM reach r WHERE r.plan_id = f.plan_id AND r.scenario = v.scenario AND r.site_id <> f.site_id GROUP BY 1) x
      JOIN weighted w ON w.demand_id = x.demand_id AND w.scenario = v.scenario), 0) AS s
  FROM psite f CROSS JOIN (VALUES ('base', 0.7::DOUBLE), ('storm', 0.3::DOUBLE)) v(scenario, sw)),
loss AS (SELECT a.plan_id, a.lost, sum(a.s / t.t * a.sw) / sum(a.sw) AS c FROM alone a JOIN total t USING (scenario) GROUP BY ALL)"""


@query(
    "coverage_without_site",
    with_sql(
        DEMAND, SITE, pairs_sql(SERVICE_KM), WEIGHT_SQL, REGION_SITES_SQL, LOSS_SQL,
        body="SELECT plan_id, lost AS site_id, round(c, 9) AS coverage FROM loss",
    ),
)
def coverage_without_site(spark, sf):
    """Leave-one-out coverage for every site of every region plan."""
    plans, rows = region_plans(spark, sf)
    found = s.resilience_by_site(rows, plans, one_problem(spark, sf, redundancy=F.lit(2)), world_evidence(spark, sf))
    return found.filter(F.col("group_name") == "").select("plan_id", "site_id", F.round("coverage", 9).alias("coverage"))


@query(
    "region_plan_resilience",
    with_sql(
        DEMAND, SITE, pairs_sql(REACH_KM), WEIGHT_SQL, REGION_SITES_SQL, LOSS_SQL,
        "twice AS (SELECT plan_id, demand_id FROM psite JOIN pair USING (site_id) GROUP BY ALL HAVING count(*) >= 2)",
        "red AS (SELECT plan_id, sum(need) / (SELECT sum(need) FROM demand) AS r FROM twice JOIN demand USING (demand_id) GROUP BY 1)",
        body="SELECT plan_id, round(min(c), 9) AS one_failure_coverage, round(max(r), 9) AS redundant_coverage FROM loss JOIN red USING (plan_id) GROUP BY plan_id",
    ),
)
def region_plan_resilience(spark, sf):
    plans, rows = region_plans(spark, sf)
    problem = one_problem(spark, sf, family=F.lit("resilient_coverage"), redundancy=F.lit(2))
    found = s.resilience_metrics(rows, plans, problem, world_evidence(spark, sf, REACH_KM)).filter(F.col("group_name") == "")
    return found.select("plan_id", *[F.round(c, 9).alias(c) for c in ("one_failure_coverage", "redundant_coverage")])


ALLOC_SQL = """alloc AS (SELECT o.o_orderpriority AS plan_id, o.o_custkey AS demand_id, l.l_suppkey AS site_id, sum(l.l_quantity) AS amount
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL)"""


def order_allocations(spark, sf):
    """Quantities per priority, customer and supplier as allocations, with the access of just those arcs."""
    from siteplan.functions import geo

    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    amounts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_orderpriority").alias("plan_id"), F.col("o_custkey").alias("demand_id"), F.col("l_suppkey").alias("site_id")
    ).agg(F.sum("l_quantity").alias("amount"))
    arcs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("demand_id"), F.col("l_suppkey").alias("site_id")
    ).distinct()
    o = demand(spark, sf).select("demand_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    d = site(spark, sf).select("site_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    placed = arcs.join(o, "demand_id").join(d, "site_id")
    reach = _world(placed.select(
        F.lit("base").alias("scenario"), "demand_id", "site_id", geo.haversine("lon1", "lat1", "lon2", "lat2").alias("access")
    ))
    ev = world_evidence(spark, sf)
    ev = s.Evidence(ev.demand, ev.sites, ev.service, ev.scenarios, reach, groups=ev.groups)
    problems = problems_table(spark, sf, family=F.lit(s.CAPACITY_FAMILY))
    plans = problems.select(F.col("problem_id").alias("plan_id"), "problem_id")
    return amounts, plans, problems, ev


HAV = "2 * 6371.0088 * asin(sqrt(least(greatest(power(sin((radians(s.lat) - radians(d.lat)) / 2), 2) + cos(radians(d.lat)) * cos(radians(s.lat)) * power(sin((radians(s.lon) - radians(d.lon)) / 2), 2), 0.0), 1.0)))"


@query(
    "allocation_totals",
    with_sql(
        DEMAND, SITE, ALLOC_SQL,
        "t AS (SELECT grp, sum(need) AS n FROM demand GROUP BY 1)",
        f"a AS (SELECT x.plan_id, d.grp, sum(x.amount) AS served, sum(x.amount * {HAV}) AS acc FROM alloc x JOIN demand d USING (demand_id) JOIN site s USING (site_id) GROUP BY ALL)",
        body="""SELECT plan_id, grp AS group_name, round(served / n, 9) AS coverage, round(served, 4) AS served_demand, round(n - served, 4) AS unmet_demand, round(acc / served, 6) AS average_access
FROM a JOIN t USING (grp)""",
    ),
)
def allocation_totals(spark, sf):
    amounts, plans, problems, ev = order_allocations(spark, sf)
    found = s.allocation_metrics(amounts, plans, problems, ev).filter(F.col("group_name") != "")
    return found.select(
        "plan_id", "group_name", F.round("coverage", 9).alias("coverage"), F.round("served_demand", 4).alias("served_demand"),
        F.round("unmet_demand", 4).alias("unmet_demand"), F.round("average_access", 6).alias("average_access"),
    )


@query(
    "allocation_issues",
    with_sql(
        DEMAND, SITE, ALLOC_SQL,
        "bad AS (SELECT x.*, s.existing, s.capacity, d.need FROM alloc x JOIN site s USING (site_id) JOIN demand d USING (demand_id))",
        body="""SELECT plan_id, 'invalid_allocation_arc' AS code FROM bad WHERE NOT existing GROUP BY plan_id
UNION ALL SELECT plan_id, 'demand_overallocation' FROM (SELECT plan_id FROM bad GROUP BY plan_id, demand_id HAVING sum(amount) > max(need) + 1e-9) GROUP BY plan_id
UNION ALL SELECT plan_id, 'capacity_exceeded' FROM (SELECT plan_id FROM bad GROUP BY plan_id, site_id HAVING sum(amount) > max(capacity) + 1e-9) GROUP BY plan_id""",
    ),
)
def allocation_issues(spark, sf):
    amounts, plans, problems, ev = order_allocations(spark, sf)
    chosen = plans.select("plan_id", "problem_id").join(
        problems.select("problem_id", "evidence_id"), "problem_id"
    ).join(ev.sites.filter("existing").select("evidence_id", "site_id"), "evidence_id").select("plan_id", "site_id")
    return validation.validate_allocations(amounts, chosen, plans, problems, ev)


LISTED_SQL = """listed AS (SELECT l_orderkey AS plan_id, CASE WHEN l_quantity > 49 THEN l_suppkey + 1000000 ELSE l_suppkey END AS site_id FROM lineitem)"""


def _listed(spark, sf):
    """Order lines as raw site lists: repeated and unknown sites stay in."""
    stray = F.when(F.col("l_quantity") > 49, F.col("l_suppkey") + 1000000).otherwise(F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), stray.alias("site_id"))


@query(
    "plan_issues",
    with_sql(
        SITE, LISTED_SQL,
        """tot AS (SELECT o.o_orderkey AS plan_id, count(l.site_id) AS listed, count(DISTINCT l.site_id) AS dis, count(s.site_id) AS n, count(*) FILTER (WHERE l.site_id IS NOT NULL AND s.site_id IS NULL) AS unk,
    count(*) FILTER (WHERE NOT s.eligible) AS bad, count(DISTINCT s.site_id) FILTER (WHERE s.existing) AS kept, coalesce(sum(s.opening_cost) FILTER (WHERE NOT s.existing), 0) AS cost
  FROM orders o LEFT JOIN listed l ON l.plan_id = o.o_orderkey LEFT JOIN site s USING (site_id) GROUP BY 1)""",
        "pl AS (SELECT DISTINCT l.plan_id, s.* FROM listed l JOIN site s USING (site_id))",
        body="""SELECT plan_id, 'duplicate_site' AS code FROM tot WHERE listed > dis
UNION ALL SELECT plan_id, 'unknown_site' FROM tot WHERE unk > 0
UNION ALL SELECT plan_id, 'ineligible_site' FROM tot WHERE bad > 0
UNION ALL SELECT plan_id, 'missing_existing' FROM tot WHERE kept < (SELECT count(*) FROM site WHERE existing)
UNION ALL SELECT plan_id, 'site_limit' FROM tot WHERE n > 5
UNION ALL SELECT plan_id, 'financial_budget' FROM tot WHERE cost > 25 + 1e-9
UNION ALL SELECT DISTINCT a.plan_id, 'minimum_spacing' FROM pl a JOIN pl b ON a.plan_id = b.plan_id AND a.site_id < b.site_id
  WHERE sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) + 1e-9 < 12""",
    ),
)
def plan_issues(spark, sf):
    plans, _ = order_plans(spark, sf)
    problems = problems_table(spark, sf, site_limit=F.lit(5), financial_budget=F.lit(25.0), minimum_spacing=F.lit(12.0))
    return validation.structural_issues(_listed(spark, sf), plans, problems, world_evidence(spark, sf))


@query(
    "plan_opening_cost",
    with_sql(
        SITE, ORDER_SITES_SQL,
        body="SELECT o.o_orderkey AS plan_id, coalesce(sum(s.opening_cost) FILTER (WHERE NOT s.existing), 0) AS opening_cost FROM orders o LEFT JOIN psite p ON p.plan_id = o.o_orderkey LEFT JOIN site s USING (site_id) GROUP BY 1",
    ),
)
def plan_opening_cost(spark, sf):
    plans, rows = order_plans(spark, sf)
    return s.plan_cost(rows, plans, problems_table(spark, sf), world_evidence(spark, sf))


@query(
    "close_sites_in_plans",
    with_sql(
        SITE, ORDER_SITES_SQL,
        "pl AS (SELECT p.plan_id, s.* FROM psite p JOIN site s USING (site_id))",
        body="""SELECT plan_id, left_site, right_site, round(distance, 6) AS distance FROM (
  SELECT a.plan_id, a.site_id AS left_site, b.site_id AS right_site, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS distance
  FROM pl a JOIN pl b ON a.plan_id = b.plan_id AND a.site_id < b.site_id) WHERE distance + 1e-9 < 15""",
    ),
)
def close_sites_in_plans(spark, sf):
    plans, rows = order_plans(spark, sf)
    found = validation.spacing_violations(rows, plans, problems_table(spark, sf, minimum_spacing=F.lit(15.0)), world_evidence(spark, sf))
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "omitted_existing_sites",
    with_sql(
        SITE, REGION_SITES_SQL,
        body="SELECT r.r_regionkey AS plan_id, s.site_id FROM region r CROSS JOIN site s WHERE s.existing AND NOT EXISTS (SELECT 1 FROM psite p WHERE p.plan_id = r.r_regionkey AND p.site_id = s.site_id)",
    ),
)
def omitted_existing_sites(spark, sf):
    plans, rows = region_plans(spark, sf)
    return validation.missing_existing(rows, plans, one_problem(spark, sf), world_evidence(spark, sf))


@query(
    "unknown_plan_sites",
    with_sql(LISTED_SQL, body="SELECT plan_id, site_id FROM listed WHERE site_id NOT IN (SELECT s_suppkey FROM supplier)"),
)
def unknown_plan_sites(spark, sf):
    return validation.unknown_ids(_listed(spark, sf), site(spark, sf), ["site_id"]).select("plan_id", "site_id")


@query(
    "misaligned_labels",
    """SELECT CAST(s_suppkey AS VARCHAR) AS label, CAST(s_suppkey AS BIGINT) AS ord FROM supplier WHERE s_suppkey % 10 = 3
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey + 1 AS BIGINT) FROM supplier WHERE s_suppkey % 10 = 3""",
)
def misaligned_labels(spark, sf):
    """Matrix columns against the candidate order: every tenth label sits one place off."""
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    matrix = suppliers.select(key.cast("string").alias("col_id"), F.when(key % 10 == 3, key + 1).otherwise(key).alias("col_ord"))
    labels = suppliers.select(key.alias("site_id"), key.alias("ord"))
    return validation.matrix_mismatch(matrix, labels, "site_id", "ord", "col_id", "col_ord")


def _scored_orders(spark, sf):
    family = (
        F.when(F.col("problem_id") < "2", "max_weighted_coverage").when(F.col("problem_id") < "3", "min_cost_target_coverage")
        .when(F.col("problem_id") < "4", "incremental_coverage").otherwise("equity_coverage")
    )
    fair = F.when(F.col("problem_id") >= "4", "max_min").otherwise("none")
    target = F.when((F.col("problem_id") >= "2") & (F.col("problem_id") < "3"), 0.02)
    problems = problems_table(
        spark, sf, family=family, equity=fair, coverage_target=target, site_limit=F.lit(8), new_site_limit=F.lit(4), financial_budget=F.lit(40.0)
    )
    ev = world_evidence(spark, sf)
    # Every supplier may be selected here and none is mandatory.
    free = ev.sites.withColumns({"eligible": F.lit(True), "existing": F.col("site_id") < 0})
    ev = s.Evidence(ev.demand, free, ev.service, ev.scenarios, None, ev.multipliers, ev.failed, ev.groups)
    plans, rows = order_plans(spark, sf)
    families = ("max_weighted_coverage", "min_cost_target_coverage", "incremental_coverage", "equity_coverage")
    return scorecards.score_plans(problems, plans, rows, ev, families=families)


SCORE_SQL = with_sql(
    DEMAND, SITE, pairs_sql(SERVICE_KM), WEIGHT_SQL, ORDER_SITES_SQL,
    f"""cov AS (SELECT p.plan_id, v.scenario, q.demand_id, max(exp(-q.km / 400)) AS c FROM psite p JOIN pair q USING (site_id)
  CROSS JOIN (VALUES ('base'), ('storm')) v(scenario) WHERE {FAILED_SQL} GROUP BY ALL)""",
    "gt AS (SELECT scenario, sw, grp, sum(w) AS t FROM weighted GROUP BY ALL UNION ALL SELECT scenario, sw, '', sum(w) FROM weighted GROUP BY ALL)",
    "gs AS (SELECT c.plan_id, c.scenario, w.grp, sum(c.c * w.w) AS s FROM cov c JOIN weighted w USING (scenario, demand_id) GROUP BY ALL)",
    "gsa AS (SELECT * FROM gs UNION ALL SELECT plan_id, scenario, '', sum(s) FROM gs GROUP BY ALL)",
    """cm AS (SELECT o.o_orderkey AS plan_id, t.grp, sum(coalesce(x.s, 0) / t.t * t.sw) / sum(t.sw) AS c FROM orders o CROSS JOIN gt t
  LEFT JOIN gsa x ON x.plan_id = o.o_orderkey AND x.scenario = t.scenario AND x.grp = t.grp GROUP BY ALL)""",
    "wide AS (SELECT plan_id, max(c) FILTER (WHERE grp = '') AS coverage, min(c) FILTER (WHERE grp <> '') AS worst FROM cm GROUP BY 1)",
    "tot AS (SELECT plan_id, count(*) AS n, sum(opening_cost) AS cost FROM psite JOIN site USING (site_id) GROUP BY 1)",
    """sc AS (SELECT o.o_orderkey AS plan_id, o.o_orderpriority AS problem_id, w.coverage, w.worst, coalesce(t.n, 0) AS n, coalesce(t.cost, 0) AS cost,
    CASE WHEN coalesce(t.n, 0) > 8 OR coalesce(t.cost, 0) > 40 + 1e-9 OR (o.o_orderpriority LIKE '3%' AND coalesce(t.n, 0) > 4) THEN
      concat_ws(',', CASE WHEN coalesce(t.cost, 0) > 40 + 1e-9 THEN 'financial_budget' END, CASE WHEN o.o_orderpriority LIKE '3%' AND coalesce(t.n, 0) > 4 THEN 'new_site_limit' END, CASE WHEN coalesce(t.n, 0) > 8 THEN 'site_limit' END)
    WHEN o.o_orderpriority LIKE '2%' AND w.coverage + 1e-9 < 0.02 THEN 'coverage_target' ELSE '' END AS violations
  FROM orders o JOIN wide w ON w.plan_id = o.o_orderkey LEFT JOIN tot t ON t.plan_id = o.o_orderkey)""",
    """key AS (SELECT *, CASE WHEN violations <> '' THEN [-1e300] WHEN problem_id LIKE '2%' THEN [-cost, coverage] WHEN problem_id >= '4' THEN [worst, coverage, -cost] ELSE [coverage, worst, -cost] END AS comparator FROM sc)""",
    body="""SELECT plan_id, problem_id, violations = '' AS feasible, violations, n AS site_count, cost AS opening_cost, round(coverage, 9) AS coverage, round(worst, 9) AS worst_group,
  round(comparator[1], 9) AS key1, round(comparator[2], 9) AS key2, round(comparator[3], 9) AS key3 FROM key""",
)


@query("plan_scores", SCORE_SQL)
def plan_scores(spark, sf):
    """Full scorecards of all order plans under four problem families."""
    scores = _scored_orders(spark, sf)
    at = lambda i: F.round(F.get("comparator", F.lit(i)), 9)
    return scores.select(
        "plan_id", "problem_id", "feasible", F.array_join("violations", ",").alias("violations"), "site_count", "opening_cost",
        F.round("coverage", 9).alias("coverage"), F.round("worst_group", 9).alias("worst_group"),
        at(0).alias("key1"), at(1).alias("key2"), at(2).alias("key3"),
    )


@query(
    "best_plan_per_problem",
    "WITH scored AS (" + SCORE_SQL + """), r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY key1 DESC, key2 DESC, coalesce(key3, -1e308) DESC, plan_id) AS rn FROM scored WHERE feasible)
SELECT problem_id, plan_id, coverage, opening_cost FROM r WHERE rn = 1""",
)
def best_plan_per_problem(spark, sf):
    best = s.best_plan(_scored_orders(spark, sf).withColumn("ordinal", F.col("plan_id")), ["problem_id"])
    return best.select("problem_id", "plan_id", F.round("coverage", 9).alias("coverage"), "opening_cost")


@query(
    "compared_neighbors",
    """WITH k AS (SELECT o_orderkey AS id, [CAST(o_orderkey % 3 AS DOUBLE), round(o_totalprice / 1000) ] AS key, o_orderstatus <> 'P' AS ok FROM orders),
n AS (SELECT a.id, a.ok AS aok, b.ok AS bok, a.key AS ak, b.key AS bk FROM k a JOIN k b ON b.id = a.id + 1)
SELECT id, CAST(CASE WHEN aok <> bok THEN CASE WHEN aok THEN 1 ELSE -1 END WHEN ak[1] > bk[1] + 1e-9 THEN 1 WHEN ak[1] < bk[1] - 1e-9 THEN -1
  WHEN ak[2] > bk[2] + 1e-9 THEN 1 WHEN ak[2] < bk[2] - 1e-9 THEN -1 ELSE 0 END AS INT) AS comparison FROM n""",
)
def compared_neighbors(spark, sf):
    """Tolerance comparison of each order's key with the next order's."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("h").alias("problem_hash"), (F.col("o_orderstatus") != "P").alias("feasible"),
        F.array((F.col("o_orderkey") % 3).cast("double"), F.round(F.col("o_totalprice") / 1000)).alias("comparator"),
    )
    return s.compare(rows, rows.withColumn("id", F.col("id") - 1), ["id"])


@query(
    "problem_issues",
    with_sql(
        SITE,
        "n AS (SELECT nation, count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE existing) AS x FROM site GROUP BY 1)",
        """p AS (SELECT c_custkey AS id, c_nationkey AS nation, list_extract(['max_weighted_coverage','min_cost_target_coverage','equity_coverage','incremental_coverage','resilient_coverage','weighted_p_median','p_center','quantile_access','capacitated_allocation'], CAST(c_custkey % 9 + 1 AS INT)) AS family,
    CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 + 1 END AS lim, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS newlim, CASE WHEN c_custkey % 7 = 0 THEN 10.0 END AS budget,
    CASE WHEN c_custkey % 3 = 0 THEN 0.5 END AS target, CASE WHEN c_custkey % 4 = 1 THEN 'max_min' ELSE 'none' END AS equity, 3 AS red FROM customer)""",
        "f AS (SELECT p.*, coalesce(n.e, 0) AS e, coalesce(n.x, 0) AS x, family IN ('weighted_p_median', 'p_center', 'quantile_access') AS acc FROM p LEFT JOIN n USING (nation))",
        body="""SELECT id AS problem_id, code FROM (
SELECT id, 'missing_budget' AS code FROM f WHERE lim IS NULL AND newlim IS NULL AND budget IS NULL
UNION ALL SELECT id, 'missing_groups' FROM f WHERE equity <> 'none'
UNION ALL SELECT id, 'unsupported_max_min' FROM f WHERE equity = 'max_min' AND family <> 'equity_coverage'
UNION ALL SELECT id, 'coverage_policy_on_access_problem' FROM f WHERE acc AND (target IS NOT NULL OR equity <> 'none')
UNION ALL SELECT id, 'unsupported_new_site_limit' FROM f WHERE newlim IS NOT NULL AND family <> 'incremental_coverage'
UNION ALL SELECT id, 'missing_target' FROM f WHERE family = 'min_cost_target_coverage' AND target IS NULL
UNION ALL SELECT id, 'missing_site_limit' FROM f WHERE acc AND lim IS NULL
UNION ALL SELECT id, 'missing_equity_policy' FROM f WHERE family = 'equity_coverage' AND equity = 'none'
UNION ALL SELECT id, 'missing_new_site_limit' FROM f WHERE family = 'incremental_coverage' AND newlim IS NULL
UNION ALL SELECT id, 'insufficient_sites' FROM f WHERE family = 'resilient_coverage' AND coalesce(lim, e) < red
UNION ALL SELECT id, 'existing_over_limit' FROM f WHERE x > lim
UNION ALL SELECT id, 'no_candidates' FROM f WHERE e = 0)""",
    ),
)
def problem_issues(spark, sf):
    """One policy per customer over the suppliers of its nation."""
    problems, ev = _customer_problems(spark, sf)
    return validation.validate_problem(problems, ev).select(F.col("problem_id"), "code")


def _customer_problems(spark, sf):
    key = F.col("c_custkey")
    names = ("max_weighted_coverage", "min_cost_target_coverage", "equity_coverage", "incremental_coverage", "resilient_coverage",
             "weighted_p_median", "p_center", "quantile_access", "capacitated_allocation")
    problems = table(spark, sf, "customer").select(
        key.alias("problem_id"), F.col("c_nationkey").alias("evidence_id"), F.get(F.array(*map(F.lit, names)), (key % 9).cast("int")).alias("family"),
        F.when(key % 2 == 0, key % 4 + 1).cast("int").alias("site_limit"), F.when(key % 5 == 0, 2).alias("new_site_limit"),
        F.when(key % 7 == 0, 10.0).alias("financial_budget"), F.when(key % 3 == 0, 0.5).alias("coverage_target"), F.lit(0.5).alias("quantile"),
        F.lit(3).alias("redundancy"), F.when(key % 4 == 1, "max_min").otherwise("none").alias("equity"), F.lit("expected").alias("aggregation"),
        F.lit(None).cast("double").alias("minimum_spacing"),
    )
    sites = site(spark, sf).withColumn("evidence_id", F.col("nation"))
    people = demand(spark, sf).withColumn("evidence_id", F.col("nation"))
    service = sites.select("evidence_id", F.lit("base").alias("scenario"), F.lit(0).alias("demand_id"), "site_id", F.lit(1.0).alias("benefit"))
    scenarios = table(spark, sf, "nation").select(F.col("n_nationkey").alias("evidence_id"), F.lit("base").alias("scenario"), F.lit(1.0).alias("weight"))
    return problems, s.Evidence(people, sites, service, scenarios)


@query(
    "policy_variants",
    """SELECT CAST(c_custkey AS VARCHAR) || '/' || v.variant AS problem_id, CAST(CASE v.variant WHEN 'tight' THEN 1 ELSE 6 END AS INT) AS site_limit
FROM customer CROSS JOIN (VALUES ('tight'), ('wide')) v(variant)""",
)
def policy_variants(spark, sf):
    """Two complete variants of every customer's policy, each with its own hash."""
    problems, _ = _customer_problems(spark, sf)
    options = F.array(
        F.struct(F.lit("tight").alias("variant"), F.lit(1).alias("site_limit")), F.struct(F.lit("wide").alias("variant"), F.lit(6).alias("site_limit"))
    )
    variants = problems.select("problem_id", F.explode(options).alias("v")).select("problem_id", "v.*")
    return search.policy_grid(problems, variants, ["site_limit"]).select("problem_id", "site_limit")


def _block_problems(spark, sf, limit=2, km=4000.0):
    """One coverage problem per block of four suppliers and sixty customers, pairs within ``km``.

    Blocks keep a problem small however large the tables are.
    """
    from siteplan.functions import geo

    block = lambda key, size: F.floor(F.col(key) / size).cast("bigint")
    sites = site(spark, sf).withColumns(
        {"evidence_id": block("site_id", 4), "ord": F.col("site_id"), "existing": F.col("site_id") % 40 == 0, "eligible": F.lit(True)}
    ).withColumnsRenamed({"lon": "x", "lat": "y"})
    people = demand(spark, sf).withColumn("evidence_id", block("demand_id", 60))
    pairs = people.select("evidence_id", "demand_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).join(
        sites.select("evidence_id", "site_id", F.col("x").alias("lon2"), F.col("y").alias("lat2")), "evidence_id"
    ).withColumn("km", geo.haversine("lon1", "lat1", "lon2", "lat2")).filter(F.col("km") <= km)
    service = pairs.select("evidence_id", F.lit("base").alias("scenario"), "demand_id", "site_id", F.lit(1.0).alias("benefit"))
    blocks = sites.select("evidence_id").distinct()
    scenarios = blocks.select("evidence_id", F.lit("base").alias("scenario"), F.lit(1.0).alias("weight"))
    kinds = dict(f.split(" ") for f in s.PROBLEM_SCHEMA.split(", "))
    columns = {"problem_id": F.col("evidence_id"), "evidence_id": F.col("evidence_id"), "family": F.lit("max_weighted_coverage"), "aggregation": F.lit("expected"), "site_limit": F.lit(limit)}
    problems = blocks.select(*[
        columns.get(n, F.lit(None)).cast("bigint" if n in ("problem_id", "evidence_id") else k).alias(n) for n, k in kinds.items()
    ])
    return problems, s.Evidence(people, sites, service, scenarios)


@query(
    "neighborhood",
    with_sql(
        SITE,
        "ns AS (SELECT site_id // 4 AS ev, site_id, site_id % 40 = 0 AS fixed FROM site)",
        "sel AS (SELECT ev, site_id, fixed FROM (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY site_id) AS rn FROM ns) WHERE rn <= 2 OR fixed)",
        "free AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY site_id) - 1 AS r, count(*) OVER (PARTITION BY ev) AS n FROM ns WHERE (ev, site_id) NOT IN (SELECT ev, site_id FROM sel))",
        "mov AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY site_id) - 1 AS r FROM sel WHERE NOT fixed)",
        "moves AS (SELECT ev, r AS ordinal, site_id AS inn, NULL AS outt FROM free UNION ALL SELECT f.ev, f.n + m.r * f.n + f.r, f.site_id, m.site_id FROM free f JOIN mov m USING (ev))",
        body="""SELECT m.ev AS parent_id, CAST(m.ordinal AS BIGINT) AS ordinal, string_agg(CAST(x.site_id AS VARCHAR), ',' ORDER BY x.site_id) AS sites FROM moves m
JOIN (SELECT ev, ordinal, inn AS site_id FROM moves UNION ALL SELECT m.ev, m.ordinal, s.site_id FROM moves m JOIN sel s ON s.ev = m.ev AND (m.outt IS NULL OR s.site_id <> m.outt)) x
  ON x.ev = m.ev AND x.ordinal = m.ordinal GROUP BY ALL""",
    ),
)
def neighborhood(spark, sf):
    """Add and swap neighbours of each block's plan (its two first suppliers and the mandatory ones)."""
    from siteplan.operators.ordered import positions

    problems, ev = _block_problems(spark, sf)
    plans = problems.select(F.col("problem_id").alias("plan_id"), "problem_id")
    ranked = positions(ev.sites, ["evidence_id"], ["ord"], name="r").filter("r <= 2 or existing")
    rows = ranked.select(F.col("evidence_id").alias("plan_id"), "site_id")
    found, _ = search.neighbors(plans, rows, problems, ev)
    return found.select("parent_id", "ordinal", F.array_join(F.transform("sites", lambda v: v.cast("string")), ",").alias("sites"))


@query(
    "enumerated_plans",
    with_sql(
        SITE,
        "f AS (SELECT site_id // 4 AS ev, site_id, row_number() OVER (PARTITION BY site_id // 4 ORDER BY site_id) - 1 AS r FROM site)",
        """c AS (SELECT DISTINCT ev, 0 AS k, -1 AS a, -1 AS b, '' AS sites FROM f UNION ALL SELECT ev, 1, r, -1, CAST(site_id AS VARCHAR) FROM f
  UNION ALL SELECT x.ev, 2, x.r, y.r, CAST(x.site_id AS VARCHAR) || ',' || CAST(y.site_id AS VARCHAR) FROM f x JOIN f y ON x.ev = y.ev AND x.r < y.r)""",
        body="SELECT ev AS problem_id, row_number() OVER (PARTITION BY ev ORDER BY k, a, b) - 1 AS ordinal, count(*) OVER (PARTITION BY ev) AS total, sites FROM c",
    ),
)
def enumerated_plans(spark, sf):
    """All site subsets of up to two suppliers per block."""
    problems, ev = _block_problems(spark, sf)
    free = ev.sites.withColumn("existing", F.lit(False))
    ev = s.Evidence(ev.demand, free, ev.service, ev.scenarios)
    plans, rows = search.enumerate_plans(problems, ev, 1_000_000)
    listed = rows.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "site_id"))), lambda e: e["site_id"].cast("string")).alias("l"))
    joined = plans.join(listed, "plan_id", "left")
    return joined.select("problem_id", "ordinal", "total", F.coalesce(F.array_join("l", ","), F.lit("")).alias("sites"))


@query(
    "exact_reference",
    with_sql(
        DEMAND, SITE,
        "ns AS (SELECT site_id // 4 AS ev, site_id, opening_cost FROM site)",
        "np AS (SELECT d.demand_id // 60 AS ev, d.demand_id, d.need, s.site_id FROM demand d JOIN site s ON s.site_id // 4 = d.demand_id // 60 WHERE " + HAV + " <= 4000.0)",
        """c AS (SELECT DISTINCT ev, 0 AS k, -1 AS a, -1 AS b, 0.0::DOUBLE AS cost FROM ns UNION ALL SELECT ev, 1, site_id, -1, opening_cost FROM ns
  UNION ALL SELECT x.ev, 2, x.site_id, y.site_id, x.opening_cost + y.opening_cost FROM ns x JOIN ns y ON x.ev = y.ev AND x.site_id < y.site_id)""",
        "t AS (SELECT demand_id // 60 AS ev, sum(need) AS t FROM demand GROUP BY 1)",
        """sc AS (SELECT c.*, coalesce((SELECT sum(need) FROM (SELECT DISTINCT demand_id, need FROM np WHERE np.ev = c.ev AND np.site_id IN (c.a, c.b))), 0) / t.t AS cov FROM c JOIN t USING (ev))""",
        "r AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY round(cov, 9) DESC, cost, k, a, b) AS rn FROM sc)",
        body="SELECT ev AS problem_id, 'exact_optimum' AS kind, round(cov, 9) AS coverage, cost AS opening_cost FROM r WHERE rn = 1",
    ),
)
def exact_reference(spark, sf):
    """Exact best coverage of every block by complete enumeration."""
    problems, ev = _block_problems(spark, sf)
    ev = s.Evidence(ev.demand, ev.sites.withColumn("existing", F.lit(False)), ev.service, ev.scenarios)
    plans, rows = search.enumerate_plans(problems, ev, 1_000_000)
    scores = scorecards.score_plans(problems, plans.select("plan_id", "problem_id"), rows, ev, families=("max_weighted_coverage",))
    best = search.reference_solution(scores, plans)
    return best.select("problem_id", "kind", F.round("coverage", 9).alias("coverage"), "opening_cost")


@query("greedy_sites")
def greedy_sites(spark, sf):
    """Greedy baseline of every block, compared with brute force in the tests."""
    problems, ev = _block_problems(spark, sf)
    return search.greedy_coverage(problems, ev, 4)


@query("improvement_pass")
def improvement_pass(spark, sf):
    """One add/swap pass from each block's first supplier; its neighbourhoods and scores are tested on small fixtures."""
    problems, ev = _block_problems(spark, sf)
    ev = s.Evidence(ev.demand, ev.sites.withColumn("existing", F.lit(False)), ev.service, ev.scenarios)
    first = ev.sites.groupBy("evidence_id").agg(F.min("site_id").alias("site_id"))
    name = F.col("evidence_id").cast("string").alias("plan_id")
    plans, rows = first.select(name, F.col("evidence_id").alias("problem_id")), first.select(name, "site_id")
    better, _ = search.improve(problems, plans, rows, ev, families=("max_weighted_coverage",))
    return better.select("parent_id", "ordinal", "plan_id", F.round("coverage", 9).alias("coverage"), "opening_cost")


@query(
    "greedy_tie_order",
    "SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_size DESC, list_transform(string_split(p_name, ''), lambda c: -unicode(c)) || [1000000] DESC, p_partkey) AS BIGINT) AS place FROM part",
)
def greedy_tie_order(spark, sf):
    """Greedy tie-break order of all parts: larger size first, then smaller names, longer of a prefix pair first."""
    from siteplan.operators.ordered import positions

    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (-F.col("p_size")).alias("size"), "p_name")
    # Reversing the sign turns the descending key into an ascending order; the pad ends a prefix last.
    key = F.concat(F.transform(descending_code_points("p_name"), lambda v: -v), F.array(F.lit(1000000)))
    return positions(rows.withColumn("key", key), [], ["size", "key", "id"], name="place").select("id", "place")


@query(
    "scenario_demand",
    with_sql(
        DEMAND, WEIGHT_SQL,
        body="SELECT demand_id, scenario, round(w, 6) AS need FROM weighted WHERE scenario = 'storm'",
    ),
)
def scenario_demand(spark, sf):
    people = demand(spark, sf)
    storm = people.select(F.lit("storm").alias("scenario"), "demand_id", F.when(F.col("demand_id") % 3 == 0, 2.0).otherwise(1.0).alias("multiplier"))
    return tables.scenario_demand(people, storm).select("demand_id", "scenario", F.round("need", 6).alias("need"))


@query(
    "unsuited_tags",
    """SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND len(list_intersect([lower(p_type), p_brand], ['economy', 'Brand#4'])) > 0""",
)
def unsuited_tags(spark, sf):
    """Parts carrying every asked tag and any of the problem tags."""
    parts = table(spark, sf, "part").select(
        "p_partkey", F.split("p_name", " ").alias("tags"), F.array(F.lower("p_type"), F.col("p_brand")).alias("problem_tags")
    )
    return quality.filter_tags(parts, "tags", ["red"], "problem_tags", ["economy", "Brand#4"]).select("p_partkey")
