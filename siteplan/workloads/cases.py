"""Exact small coverage cases, grading and name lookup: each order is a case over its suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteplan.functions.text import normalize_name
from siteplan.operators import cases as ops
from siteplan.session import shuffle_buckets
from siteplan.sources import readers
from siteplan.workloads import query
from siteplan.workloads.base import SITE, haversine_sql, site, table, with_sql

RADIUS = 4000.0
PLACE_SQL = """pl AS (SELECT o.l_orderkey AS c, CAST(row_number() OVER (PARTITION BY o.l_orderkey ORDER BY o.l_suppkey) - 1 AS INT) AS ord, o.l_suppkey AS n, o.pop, s.lon, s.lat
  FROM (SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS pop FROM lineitem GROUP BY ALL) o JOIN site s ON s.site_id = o.l_suppkey)"""
COVER_SQL = f"""near AS (SELECT a.c, a.ord AS x, b.ord AS y, b.pop FROM pl a JOIN pl b ON a.c = b.c AND {haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")} <= {RADIUS} + 1e-9)"""


def order_places(spark, sf):
    # A case is packed into one row later on, so its places are dealt out and ranked by case alone, in one shuffle.
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("site_id"), "l_quantity").filter(F.col("case_id").isNotNull())
    lines = lines.repartition(shuffle_buckets(spark), "case_id")
    rows = lines.groupBy("case_id", "site_id").agg(F.sum("l_quantity").cast("bigint").alias("population"))
    places = site(spark, sf).select("site_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    ranked = rows.join(places, "site_id").withColumn("ord", F.row_number().over(Window.partitionBy("case_id").orderBy("site_id")) - 1)
    return ranked.select("case_id", "ord", F.col("site_id").cast("string").alias("name"), "longitude", "latitude", "population")


def _cases(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id")).distinct().withColumns({"radius_km": F.lit(RADIUS), "centers": F.lit(1)})


@query(
    "best_single_center",
    with_sql(
        SITE, PLACE_SQL, COVER_SQL,
        "v AS (SELECT c, x, sum(pop) AS p FROM near GROUP BY ALL)",
        "b AS (SELECT c, max(p) AS p FROM v GROUP BY 1)",
        body="""SELECT b.c AS case_id, CAST(b.p AS BIGINT) AS people_covered, count(*) AS optimal_solution_count, (SELECT CAST(n AS VARCHAR) FROM pl WHERE pl.c = b.c AND pl.ord = min(v.x)) AS centers FROM b JOIN v ON v.c = b.c AND v.p = b.p GROUP BY b.c, b.p""",
    ),
)
def best_single_center(spark, sf):
    """Exact maximum coverage with one center per order."""
    found = ops.solve_max_coverage(order_places(spark, sf), _cases(spark, sf))
    return found.select("case_id", "people_covered", "optimal_solution_count", F.array_join("center_locations", ",").alias("centers"))


@query(
    "best_center_pair",
    with_sql(
        SITE, PLACE_SQL, COVER_SQL,
        "sz AS (SELECT c, count(*) AS n FROM pl GROUP BY 1)",
        "combo AS (SELECT a.c, a.ord AS i, b.ord AS j FROM pl a JOIN pl b ON a.c = b.c AND a.ord < b.ord UNION ALL SELECT pl.c, ord, NULL FROM pl JOIN sz USING (c) WHERE sz.n = 1)",
        "v AS (SELECT q.c, q.i, q.j, sum(q.pop) AS p FROM (SELECT DISTINCT o.c, o.i, o.j, near.y, near.pop FROM combo o JOIN near ON near.c = o.c AND (near.x = o.i OR near.x = o.j)) q GROUP BY ALL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p DESC, i, j) AS rn, count(*) OVER (PARTITION BY c, p) AS k FROM v)",
        body="""SELECT r.c AS case_id, CAST(r.p AS BIGINT) AS people_covered, r.k AS optimal_solution_count, concat_ws(',', CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR)) AS centers
FROM r JOIN pl a ON a.c = r.c AND a.ord = r.i LEFT JOIN pl b ON b.c = r.c AND b.ord = r.j WHERE rn = 1""",
    ),
)
def best_center_pair(spark, sf):
    """Exact maximum coverage with two centers (one where an order has a single supplier)."""
    places = order_places(spark, sf)
    sizes = places.groupBy("case_id").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("centers")).withColumn("radius_km", F.lit(RADIUS))
    found = ops.solve_max_coverage(places, sizes)
    return found.select("case_id", "people_covered", "optimal_solution_count", F.array_join("center_locations", ",").alias("centers"))


@query("fewest_centers")
def fewest_centers(spark, sf):
    """Fewest centers reaching 80% of each order; tested on small fixtures."""
    cases = _cases(spark, sf).withColumn("target_percent", F.lit(80.0))
    found = ops.solve_minimum_facility(order_places(spark, sf), cases)
    return found.withColumn("center_locations", F.array_join("center_locations", ","))


@query(
    "covered_people",
    with_sql(
        SITE, PLACE_SQL, COVER_SQL,
        "hit AS (SELECT DISTINCT c, y, pop FROM near WHERE x % 2 = 0)",
        body="""SELECT t.c AS case_id, CAST(coalesce(h.p, 0) AS BIGINT) AS people_covered, CAST(t.p AS BIGINT) AS total_population, CAST(ceil(t.p * 80.0 / 100) AS BIGINT) AS target_population, coalesce(h.p, 0) >= ceil(t.p * 80.0 / 100) AS target_reached
FROM (SELECT c, sum(pop) AS p FROM pl GROUP BY 1) t LEFT JOIN (SELECT c, sum(pop) AS p FROM hit GROUP BY 1) h USING (c)""",
    ),
)
def covered_people(spark, sf):
    """Population of chosen centers (every second place), each place once, against an 80% target."""
    places = order_places(spark, sf).withColumn("radius_km", F.lit(RADIUS))
    covered = ops.covered_population(places, places.filter(F.col("ord") % 2 == 0))
    return ops.target_reached(covered, _cases(spark, sf).select("case_id", F.lit(80.0).alias("target_percent"))).drop("target_percent")


@query(
    "graded_predictions",
    """WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders)
SELECT k AS case_id, CASE k % 3 WHEN 2 THEN abs(CAST(k % 50 AS DOUBLE) + (c % 5) * 0.4 - k % 50) <= 1.0 ELSE c % 4 <> 0 AND c % 2 = 1 END AND k % 10 <> 0 AS correct,
  CASE k % 3 WHEN 0 THEN c % 4 <> 0 WHEN 2 THEN abs(CAST(k % 50 AS DOUBLE) + (c % 5) * 0.4 - k % 50) <= 1.0 ELSE c % 4 <> 0 AND c % 2 = 1 END AND k % 10 <> 0 AS objective_correct FROM l""",
)
def graded_predictions(spark, sf):
    """Exact, objective and tour grading; every tenth case has no prediction."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "max_coverage").when(k % 3 == 1, "minimum_facility").otherwise("tsp")
    solutions = F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("b"), F.lit("a")))
    cases = table(spark, sf, "orders").select(k.alias("case_id"), kind.alias("kind"), (k % 50).cast("double").alias("expected_value"), solutions.alias("solutions"), F.lit(2).alias("max_centers"))
    value = F.when(k % 3 == 2, (k % 50).cast("double") + (c % 5) * 0.4).when(c % 4 == 0, -1.0).otherwise((k % 50).cast("double"))
    picked = F.when(c % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("z")))
    predictions = table(spark, sf, "orders").filter(k % 10 != 0).select(k.alias("case_id"), value.alias("value"), picked.alias("selected"))
    return ops.grade(predictions, cases, 1.0).select("case_id", "correct", "objective_correct")


@query(
    "region_place_catalog",
    with_sql(
        SITE,
        "s AS (SELECT n.n_regionkey AS region, s.site_id, s.lon, s.lat FROM site s JOIN nation n ON n.n_nationkey = s.nation)",
        "u AS (SELECT s.region, 'supplier ' || CAST(s.site_id AS VARCHAR) AS normalized, min(l.l_orderkey) AS first_case, any_value(s.lat) AS latitude FROM s JOIN lineitem l ON l.l_suppkey = s.site_id GROUP BY ALL)",
        body="SELECT region, normalized, first_case, latitude FROM u",
    ),
)
def region_place_catalog(spark, sf):
    """First occurrence of every place per region over all cases."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    sites = site(spark, sf).join(nations, "nation")
    name = F.concat(F.lit("Supplier "), F.col("site_id").cast("string"))
    known = sites.select("region", "site_id", "lon", "lat", name.alias("name")).withColumn("normalized", normalize_name("name"))
    places = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site_id"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("ord")).join(known, "site_id")
    rows = places.select("region", "case_id", "ord", "normalized", F.col("name").alias("location_id"), "name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return ops.region_catalog(rows).select("region", "normalized", F.col("first_seen.case_id").alias("first_case"), "latitude")


@query(
    "selected_cases",
    "SELECT n_nationkey FROM (SELECT n.n_nationkey FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE lower(r.r_name) IN ('asia', 'europe') ORDER BY n.n_name, n.n_nationkey LIMIT 5 OFFSET 2)",
)
def selected_cases(spark, sf):
    """Region filter without regard to case, then a slice of an explicit order."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")), "n_regionkey")
    return ops.select_cases(rows, ["n_name", "n_nationkey"], ["Asia", "EUROPE"], 2, 5).select("n_nationkey")


def _queries(spark, sf):
    """Part names with a slip as queries against all part names of the same brand."""
    parts = table(spark, sf, "part")
    slip = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.translate("p_name", "e", "")).otherwise(F.substring_index("p_name", " ", 1))
    asked = parts.select(F.col("p_brand").alias("case_id"), F.col("p_partkey").alias("ord"), slip.alias("query")).withColumn("normalized", normalize_name("query"))
    asked = asked.withColumn("query", F.concat_ws("#", "query", F.col("ord").cast("string")))
    names = parts.select(F.col("p_brand").alias("case_id"), F.col("p_name").alias("name")).distinct().withColumn("normalized", normalize_name("name"))
    return asked, names.withColumn("location_id", F.col("normalized"))


@query("name_matches")
def name_matches(spark, sf):
    """Top matches of misspelt part names within their brand; scores are recomputed in the tests."""
    return ops.search_names(*_queries(spark, sf), limit=3)


@query("resolved_names")
def resolved_names(spark, sf):
    return ops.resolve_names(*_queries(spark, sf))


@query(
    "region_matrix_gaps",
    "SELECT CAST(n_nationkey AS VARCHAR) AS region FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < -900)",
)
def region_matrix_gaps(spark, sf):
    """Regions whose stored place list no longer equals the expected one."""
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("region"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.lit(0.0).alias("latitude"), F.col("c_acctbal").alias("longitude")
    )
    return readers.signature_mismatch(rows.filter("longitude >= -900"), rows)
