"""Distances, areas, zones, nearest places and rasters over customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.operators import access, evidence, graph, overlay, quality
from siteplan.plans import scoring
from siteplan.workloads import query
from siteplan.workloads.base import (
    DEMAND, REACH_KM, SERVICE_KM, SITE, ZONE, demand, haversine_sql, od_pairs, pairs_sql, site, table, with_sql, zone,
)


@query(
    "coverage_by_segment",
    with_sql(
        DEMAND, SITE, pairs_sql(REACH_KM),
        "best AS (SELECT p.demand_id, 1.0 AS cov FROM pair p JOIN site s USING (site_id) WHERE s.existing GROUP BY 1)",
        "joined AS (SELECT d.grp, d.need, coalesce(b.cov, 0) AS cov FROM demand d LEFT JOIN best b USING (demand_id))",
        body="""SELECT '' AS group_name, round(sum(need * cov) / sum(need), 6) AS coverage, round(sum(need), 4) AS demand FROM joined
UNION ALL SELECT grp, round(sum(need * cov) / sum(need), 6), round(sum(need), 4) FROM joined GROUP BY grp""",
    ),
)
def coverage_by_segment(spark, sf):
    """Maximum weighted coverage score of the plan of all existing sites, overall and by segment."""
    people = evidence.build_demand(demand(spark, sf), "demand_id", ["need"], group=["grp"], check_ids=False)
    people = people.withColumn("evidence_id", F.lit("world"))
    pairs = od_pairs(spark, sf, REACH_KM)
    service = access.service_matrix(pairs, "binary_threshold", value="km", threshold=REACH_KM).select(
        F.lit("world").alias("evidence_id"), F.lit("base").alias("scenario"), F.col("demand_id").cast("string"), "site_id", "benefit"
    )
    sites = site(spark, sf).withColumn("evidence_id", F.lit("world"))
    groups = people.select("evidence_id", F.col("grp").alias("group_name"), "demand_id", F.lit(1.0).alias("membership"))
    scenarios = people.select("evidence_id").distinct().select("evidence_id", F.lit("base").alias("scenario"), F.lit(1.0).alias("weight"))
    ev = scoring.Evidence(people, sites, service, scenarios, groups=groups)
    problems = scenarios.select(F.lit("p").alias("problem_id"), "evidence_id", F.lit("expected").alias("aggregation"))
    plans = problems.select(F.lit("existing").alias("plan_id"), "problem_id")
    chosen = sites.filter("existing").select(F.lit("existing").alias("plan_id"), "site_id")
    metrics = scoring.coverage_metrics(chosen, plans, problems, ev)
    return metrics.select("group_name", F.round("coverage", 6).alias("coverage"), F.round("demand", 4).alias("demand"))


@query("pairs_within_reach", with_sql(DEMAND, SITE, pairs_sql(REACH_KM), body="SELECT demand_id, site_id, round(km, 6) AS km FROM pair"))
def pairs_within_reach(spark, sf):
    return od_pairs(spark, sf, REACH_KM).withColumn("km", F.round("km", 6))


@query(
    "service_benefits",
    with_sql(
        DEMAND, SITE, pairs_sql(REACH_KM),
        body="""SELECT demand_id, site_id, CASE WHEN km <= 750 THEN 1.0 ELSE 0.0 END::DOUBLE AS inside,
  round(CASE WHEN km <= 200 THEN 1.0 WHEN km <= 800 THEN 1.0 + (km - 200) * (0.4 - 1.0) / 600 WHEN km <= 1200 THEN 0.4 + (km - 800) * (0.1 - 0.4) / 400 ELSE 0.1 END, 6) AS sloped,
  round(exp(-km / 400), 6) AS decayed FROM pair""",
    ),
)
def service_benefits(spark, sf):
    pairs = od_pairs(spark, sf, REACH_KM)
    knots = [(200, 1.0), (800, 0.4), (1200, 0.1)]
    return pairs.select(
        "demand_id", "site_id",
        access.service_benefit("km", "binary_threshold", threshold=750).alias("inside"),
        F.round(access.service_benefit("km", "piecewise", knots=knots), 6).alias("sloped"),
        F.round(access.service_benefit("km", "exponential_decay", decay_scale=400), 6).alias("decayed"),
    )


@query(
    "service_range",
    with_sql(
        DEMAND, SITE, pairs_sql(REACH_KM),
        body="SELECT round(min(exp(-km / 400)), 6) AS minimum_benefit, round(max(exp(-km / 400)), 6) AS maximum_benefit FROM pair",
    ),
)
def service_range(spark, sf):
    matrix = access.service_matrix(od_pairs(spark, sf, REACH_KM), "exponential_decay", value="km", decay_scale=400)
    found = access.service_range(matrix)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "projected_pairs",
    with_sql(
        DEMAND, SITE,
        "o AS (SELECT demand_id, radians(lon) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y FROM demand)",
        "t AS (SELECT site_id, radians(lon) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y FROM site)",
        body="""SELECT * FROM (SELECT o.demand_id AS origin_id, t.site_id AS destination_id,
  round(sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y)) / 1000, 4) AS travel FROM o CROSS JOIN t) WHERE travel <= 800""",
    ),
)
def projected_pairs(spark, sf):
    """Web-Mercator coordinates and planar travel within 800 km."""
    ox, oy = geo.to_web_mercator("lon", "lat")
    o = demand(spark, sf).select(F.col("demand_id").alias("origin_id"), ox.alias("o_x"), oy.alias("o_y"))
    d = site(spark, sf).select(F.col("site_id").alias("destination_id"), ox.alias("d_x"), oy.alias("d_y"))
    pairs = access.travel_matrix(o, d, "euclidean", "kilometers", cutoff=800.0, crs="EPSG:3857")
    return pairs.withColumn("travel", F.round("travel", 4))


@query(
    "round_trip_projection",
    with_sql(DEMAND, body="SELECT demand_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM demand"),
)
def round_trip_projection(spark, sf):
    rows = demand(spark, sf).select("demand_id", *[c.alias(n) for c, n in zip(geo.to_web_mercator("lon", "lat"), "xy")])
    lon, lat = geo.from_web_mercator("x", "y")
    return rows.select("demand_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("ellipsoid_pairs")
def ellipsoid_pairs(spark, sf):
    """WGS84 distances within reach; no SQL form of the iteration, tests compare with a known arc."""
    o = demand(spark, sf).select(F.col("demand_id").alias("origin_id"), F.col("lon").alias("o_x"), F.col("lat").alias("o_y"))
    d = site(spark, sf).select(F.col("site_id").alias("destination_id"), F.col("lon").alias("d_x"), F.col("lat").alias("d_y"))
    return access.travel_matrix(o, d, "geodesic", "kilometers", cutoff=SERVICE_KM).withColumn("travel", F.round("travel", 6))


@query(
    "access_profile",
    with_sql(DEMAND, SITE, pairs_sql(REACH_KM), body="SELECT count(*) AS cell_count, 0.0::DOUBLE AS missing_fraction, 0::BIGINT AS unreachable_count FROM pair"),
)
def access_profile(spark, sf):
    return quality.profile_matrix(od_pairs(spark, sf, REACH_KM), "km")


@query(
    "points_in_zones",
    with_sql(
        DEMAND, ZONE,
        body="""SELECT d.demand_id, z.zone_id AS overlay_zone_id, z.region AS overlay_region
FROM demand d JOIN zone z ON d.lon >= z.west AND d.lon <= z.east AND d.lat >= z.south AND d.lat <= z.north""",
    ),
)
def points_in_zones(spark, sf):
    points = demand(spark, sf).select("demand_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return overlay.spatial_join(points, _polygons(spark, sf), "intersects").select("demand_id", "overlay_zone_id", "overlay_region")


def _polygons(spark, sf):
    return zone(spark, sf).select("zone_id", "region", geo.box_rings("west", "south", "east", "north").alias("rings"))


def _points(spark, sf):
    return demand(spark, sf).select("demand_id", "need", F.col("lon").alias("x"), F.col("lat").alias("y"))


@query(
    "points_strictly_within",
    with_sql(
        DEMAND, ZONE,
        body="""SELECT d.demand_id, z.zone_id AS overlay_zone_id
FROM demand d JOIN zone z ON d.lon > z.west AND d.lon < z.east AND d.lat > z.south AND d.lat < z.north""",
    ),
)
def points_strictly_within(spark, sf):
    return overlay.spatial_join(_points(spark, sf), _polygons(spark, sf), "within").select("demand_id", "overlay_zone_id")


@query(
    "zones_holding_points",
    with_sql(
        SITE, ZONE,
        body="""SELECT z.zone_id, s.site_id AS overlay_site_id
FROM zone z JOIN site s ON s.lon > z.west AND s.lon < z.east AND s.lat > z.south AND s.lat < z.north""",
    ),
)
def zones_holding_points(spark, sf):
    spots = site(spark, sf).select("site_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return overlay.spatial_join(_polygons(spark, sf), spots, "contains", left_kind="polygon").select("zone_id", "overlay_site_id")


TRIANGLE_SQL = """tri AS (SELECT zone_id, west AS x1, south AS y1, east AS x2, south AS y2, west + 20 AS x3, north AS y3 FROM zone),
seg AS (SELECT zone_id, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by FROM tri UNION ALL SELECT zone_id, x2, y2, x3, y3 FROM tri UNION ALL SELECT zone_id, x3, y3, x1, y1 FROM tri),
test AS (SELECT d.demand_id, s.zone_id,
    (s.ay > d.lat) <> (s.by > d.lat) AND CASE WHEN s.by - s.ay > 0 THEN (d.lon - s.ax) * (s.by - s.ay) < (s.bx - s.ax) * (d.lat - s.ay)
      ELSE (d.lon - s.ax) * (s.by - s.ay) > (s.bx - s.ax) * (d.lat - s.ay) END AS crossed,
    (s.bx - s.ax) * (d.lat - s.ay) = (s.by - s.ay) * (d.lon - s.ax) AND d.lon BETWEEN least(s.ax, s.bx) AND greatest(s.ax, s.bx)
      AND d.lat BETWEEN least(s.ay, s.by) AND greatest(s.ay, s.by) AS edge
  FROM demand d CROSS JOIN seg s),
hit AS (SELECT demand_id, zone_id, bool_or(edge) AS edge, count(*) FILTER (WHERE crossed) % 2 = 1 AS inner_side FROM test GROUP BY ALL)"""


def _triangles(spark, sf):
    def corner(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    a, b = corner(F.col("west"), F.col("south")), corner(F.col("east"), F.col("south"))
    c = corner(F.col("west") + 20, F.col("north"))
    return zone(spark, sf).select("zone_id", F.array(F.array(a, b, c, a)).alias("rings"))


@query(
    "points_in_triangles",
    with_sql(DEMAND, ZONE, TRIANGLE_SQL, body="SELECT demand_id, zone_id AS overlay_zone_id FROM hit WHERE edge OR inner_side"),
)
def points_in_triangles(spark, sf):
    """Polygons with slanted edges."""
    return overlay.spatial_join(_points(spark, sf), _triangles(spark, sf), "intersects").select("demand_id", "overlay_zone_id")


@query(
    "points_kept_in_area",
    with_sql(DEMAND, ZONE, TRIANGLE_SQL, body="SELECT DISTINCT demand_id FROM hit WHERE edge OR inner_side"),
)
def points_kept_in_area(spark, sf):
    """Clip points to the union of areas."""
    return overlay.in_area(_points(spark, sf), _triangles(spark, sf), "intersects").select("demand_id")


@query(
    "zone_totals",
    with_sql(
        DEMAND, ZONE,
        body="""SELECT z.zone_id, round(sum(d.need), 4) AS need_sum, round(avg(d.need), 6) AS need_mean, min(d.need) AS need_min, max(d.need) AS need_max, count(d.demand_id) AS points
FROM zone z LEFT JOIN demand d ON d.lon >= z.west AND d.lon <= z.east AND d.lat >= z.south AND d.lat <= z.north GROUP BY z.zone_id""",
    ),
)
def zone_totals(spark, sf):
    zones, points = _polygons(spark, sf).select("zone_id", "rings"), _points(spark, sf)
    digits = {"sum": 4, "mean": 6, "min": 9, "max": 9}
    found = overlay.zonal(zones, points, "zone_id", ["need"], ["count", *digits])
    return found.select("zone_id", F.col("overlay_count").alias("points"), *[F.round(f"overlay_need_{r}", d).alias(f"need_{r}") for r, d in digits.items()])


@query(
    "zone_first_value",
    with_sql(
        DEMAND, ZONE,
        body="""SELECT z.zone_id, arg_min(d.need, d.demand_id) AS overlay_need_first
FROM zone z LEFT JOIN demand d ON d.lon > z.west AND d.lon < z.east AND d.lat > z.south AND d.lat < z.north GROUP BY z.zone_id""",
    ),
)
def zone_first_value(spark, sf):
    found = overlay.zonal(_polygons(spark, sf), _points(spark, sf), "zone_id", ["need"], "first", "within", order="demand_id")
    return found.select("zone_id", "overlay_need_first")


BOX_SQL = """sbox AS (SELECT site_id, lon - (site_id % 9) AS west, lat - (site_id % 5) AS south, lon + (site_id % 9) AS east, lat + (site_id % 5) AS north FROM site)"""


@query(
    "overlapping_boxes",
    with_sql(
        SITE, ZONE, BOX_SQL,
        body="SELECT z.zone_id, b.site_id AS overlay_site_id FROM zone z JOIN sbox b ON z.west <= b.east AND b.west <= z.east AND z.south <= b.north AND b.south <= z.north",
    ),
)
def overlapping_boxes(spark, sf):
    side, rise = F.col("site_id") % 9, F.col("site_id") % 5
    boxes = site(spark, sf).select(
        "site_id", (F.col("lon") - side).alias("west"), (F.col("lat") - rise).alias("south"),
        (F.col("lon") + side).alias("east"), (F.col("lat") + rise).alias("north"),
    )
    return overlay.box_join(zone(spark, sf).drop("region"), boxes, "intersects").select("zone_id", "overlay_site_id")


@query(
    "nearest_site",
    with_sql(
        DEMAND, SITE,
        "d2 AS (SELECT d.demand_id, s.site_id, s.opening_cost, sqrt((d.lon - s.lon) * (d.lon - s.lon) + (d.lat - s.lat) * (d.lat - s.lat)) AS dist FROM demand d CROSS JOIN site s)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY dist, site_id) AS rn FROM d2)",
        body="""SELECT demand_id, CASE WHEN dist <= 20 THEN round(dist, 6) END AS overlay_distance, CASE WHEN dist <= 20 THEN site_id END AS overlay_site_id,
  CASE WHEN dist <= 20 THEN opening_cost END AS overlay_opening_cost FROM r WHERE rn = 1""",
    ),
)
def nearest_site(spark, sf):
    """Nearest supplier in degrees, within 20, the smallest id on ties."""
    sites = site(spark, sf).select("site_id", "opening_cost", F.col("lon").alias("x"), F.col("lat").alias("y"))
    found = overlay.nearest(_points(spark, sf).drop("need"), sites, "demand_id", "site_id", "site_id", ["opening_cost"], max_distance=20.0)
    return found.select("demand_id", F.round("overlay_distance", 6).alias("overlay_distance"), "overlay_site_id", "overlay_opening_cost")


HEADER = {"a": 10.0, "b": 0.0, "c": -180.0, "d": 0.0, "e": -10.0, "f": 85.0, "nodata": 0.0}
RASTER_SQL = """cells AS (SELECT 1 AS band, CAST(p_partkey % 17 AS INT) AS row, CAST((p_partkey // 17) % 36 AS INT) AS col,
    max(CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END) AS value FROM part GROUP BY ALL)"""


def _cells(spark, sf):
    value = F.when(F.col("p_size") % 10 == 0, 0.0).otherwise(F.col("p_retailprice"))
    key = F.col("p_partkey")
    return table(spark, sf, "part").groupBy(
        F.lit(1).alias("band"), (key % 17).cast("int").alias("row"), (F.floor(key / 17) % 36).cast("int").alias("col")
    ).agg(F.max(value).alias("value"))


@query(
    "sampled_raster",
    with_sql(
        DEMAND, RASTER_SQL,
        body="""SELECT d.demand_id, c.value AS overlay_band_1 FROM demand d LEFT JOIN cells c
ON c.row = CAST(floor((85.0 - d.lat) / 10.0) AS INT) AND c.col = CAST(floor((d.lon + 180.0) / 10.0) AS INT) AND c.value <> 0""",
    ),
)
def sampled_raster(spark, sf):
    return overlay.sample_raster(_points(spark, sf), _cells(spark, sf), HEADER).select("demand_id", "overlay_band_1")


@query(
    "zone_raster_totals",
    with_sql(
        ZONE, RASTER_SQL,
        body="""SELECT z.zone_id, 1 AS band, round(sum(c.value), 4) AS value FROM zone z LEFT JOIN cells c
ON c.value <> 0 AND (c.col + 0.5) * 10 - 180 BETWEEN z.west AND z.east AND 85 - (c.row + 0.5) * 10 BETWEEN z.south AND z.north GROUP BY z.zone_id""",
    ),
)
def zone_raster_totals(spark, sf):
    found = overlay.zonal_raster(_polygons(spark, sf), _cells(spark, sf), HEADER, "zone_id", "sum")
    return found.select("zone_id", "band", F.round("value", 4).alias("value"))


@query(
    "raster_profile",
    with_sql(RASTER_SQL, body="SELECT count(DISTINCT band) AS bands, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 9) AS missing_fraction FROM cells"),
)
def raster_profile(spark, sf):
    return quality.profile_raster(_cells(spark, sf), 0.0).withColumn("missing_fraction", F.round("missing_fraction", 9))


@query(
    "coordinate_lookup",
    with_sql(
        SITE,
        "req AS (SELECT site_id AS request_id, lon + CASE WHEN site_id % 3 = 0 THEN 5e-9 WHEN site_id % 3 = 1 THEN 1e-3 ELSE 0.0 END AS lon, lat FROM site)",
        body="""SELECT r.request_id, (SELECT min(s.site_id) FROM site s WHERE abs(r.lon - s.lon) <= 1e-8 AND abs(r.lat - s.lat) <= 1e-8) AS site_id FROM req r""",
    ),
)
def coordinate_lookup(spark, sf):
    """Regional coordinate lookup with an absolute tolerance of 1e-8 degrees."""
    shift = F.when(F.col("site_id") % 3 == 0, 5e-9).when(F.col("site_id") % 3 == 1, 1e-3).otherwise(0.0)
    requests = site(spark, sf).select(F.col("site_id").alias("request_id"), (F.col("lon") + shift).alias("lon"), "lat")
    master = site(spark, sf).select("site_id", "lon", "lat")
    return access.lookup_coordinates(requests, master, "request_id", "site_id").select("request_id", "site_id")


@query(
    "grid_candidates",
    with_sql(
        DEMAND,
        "g AS (SELECT r * 36 + c + 1 AS n, c * 10.0 - 180 AS x, r * 10.0 - 80 AS y FROM range(17) t(r), range(36) u(c))",
        body=f"""SELECT 'grid-' || lpad(CAST(g.n AS VARCHAR), 6, '0') AS site_id, count(*) AS customers, round(sum(d.need), 4) AS need
FROM g JOIN demand d ON {haversine_sql("d.lon", "d.lat", "g.x", "g.y")} <= 400 GROUP BY 1""",
    ),
)
def grid_candidates(spark, sf):
    """Demand around each point of a deterministic candidate grid."""
    grid = evidence.grid_points(spark, (-180.0, -80.0, 170.0, 80.0), 10.0).withColumnsRenamed({"x": "d_lon", "y": "d_lat"})
    people = demand(spark, sf).select("demand_id", "need", F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    near = access.pairs_within_sphere(people, grid, 400.0)
    return near.groupBy("site_id").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("need"), 4).alias("need"))


@query(
    "candidate_sites",
    with_sql(
        SITE, ZONE,
        body="""SELECT CAST(site_id AS VARCHAR) AS site_id, opening_cost, capacity, eligible, existing FROM site s
WHERE EXISTS (SELECT 1 FROM zone z WHERE z.region IN (1, 3) AND s.lon >= z.west AND s.lon < z.east AND s.lat >= z.south AND s.lat < z.north)
  AND EXISTS (SELECT 1 FROM zone z WHERE z.region IN (1, 3) AND s.lon > z.west AND s.lon <= z.east AND s.lat >= z.south AND s.lat < z.north)
  AND EXISTS (SELECT 1 FROM zone z WHERE z.region IN (1, 3) AND s.lon >= z.west AND s.lon < z.east AND s.lat > z.south AND s.lat <= z.north)
  AND EXISTS (SELECT 1 FROM zone z WHERE z.region IN (1, 3) AND s.lon > z.west AND s.lon <= z.east AND s.lat > z.south AND s.lat <= z.north)""",
    ),
)
def candidate_sites(spark, sf):
    """Candidates inside the zones of two regions."""
    spots = site(spark, sf).withColumnsRenamed({"lon": "x", "lat": "y"})
    found = evidence.build_candidates(
        spots, "site_id", "opening_cost", "capacity", "eligible", "existing",
        suitability="region", allowed=[1, 3], areas=_polygons(spark, sf), check_ids=False,
    )
    return found.drop("x", "y")


@query(
    "box_filter",
    with_sql(DEMAND, body="SELECT demand_id FROM demand WHERE lon BETWEEN -20 AND 75.5 AND lat BETWEEN -40.25 AND 30"),
)
def box_filter(spark, sf):
    from siteplan.sources.readers import filter_bbox

    return filter_bbox(_points(spark, sf), -20, -40.25, 75.5, 30).select("demand_id")


@query(
    "frame_extent",
    with_sql(DEMAND, body="SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM demand"),
)
def frame_extent(spark, sf):
    return quality.extent(access.check_lonlat(_points(spark, sf), "x", "y"))


ROAD_SQL = """n AS (SELECT count(*) AS n FROM supplier),
road AS (SELECT src, dst, min(weight) AS weight FROM (
  SELECT s_suppkey AS src, (2 * s_suppkey + 1) % n AS dst, s_suppkey % 7 + 1 AS weight FROM supplier, n
  UNION ALL SELECT s_suppkey, (3 * s_suppkey + 2) % n, s_suppkey % 5 + 2 FROM supplier, n) GROUP BY ALL)"""


def roads(spark, sf):
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    sized = suppliers.select(key).withColumn("n", suppliers.agg(F.count(F.lit(1)).alias("n")).scalar())
    first = sized.select(key.alias("src"), ((key * 2 + 1) % F.col("n")).alias("dst"), (key % 7 + 1).cast("double").alias("weight"))
    second = sized.select(key.alias("src"), ((key * 3 + 2) % F.col("n")).alias("dst"), (key % 5 + 2).cast("double").alias("weight"))
    return first.unionByName(second)


@query(
    "road_costs",
    "WITH RECURSIVE " + ROAD_SQL + """,
start AS (SELECT min(s_suppkey) AS node FROM supplier GROUP BY s_nationkey),
walk AS (SELECT node AS origin, node, 0::BIGINT AS cost FROM start
  UNION SELECT w.origin, r.dst, w.cost + r.weight FROM walk w JOIN road r ON r.src = w.node WHERE w.cost + r.weight <= 60)
SELECT origin, node, CAST(min(cost) AS DOUBLE) AS cost FROM walk GROUP BY ALL""",
)
def road_costs(spark, sf):
    """Least road cost from the first supplier of every nation to every supplier it reaches."""
    starts = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("node")).select("node")
    return graph.shortest_paths(roads(spark, sf), starts, cutoff=60.0)


@query(
    "reachable_sets",
    "WITH RECURSIVE " + ROAD_SQL + """,
walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0::BIGINT AS cost FROM supplier
  UNION SELECT w.origin, r.dst, w.cost + r.weight FROM walk w JOIN road r ON r.src = w.node WHERE w.cost + r.weight <= 12),
best AS (SELECT origin, node, min(cost) AS cost FROM walk GROUP BY ALL)
SELECT origin, CAST(cutoff AS DOUBLE) AS cutoff, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes
FROM best JOIN (VALUES (5), (12)) c(cutoff) ON cost <= cutoff GROUP BY ALL""",
)
def reachable_sets(spark, sf):
    """Isochrones of every supplier at two cutoffs."""
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    sets = graph.isochrone_sets(graph.isochrones(roads(spark, sf), starts, [5.0, 12.0]))
    return sets.withColumn("nodes", F.array_join("nodes", ","))


@query(
    "graph_profile",
    "WITH " + ROAD_SQL + " SELECT (SELECT count(*) FROM supplier) AS node_count, (SELECT 2 * count(*) FROM supplier) AS edge_count, round((SELECT avg(CASE WHEN s_acctbal < 0 THEN 1.0 ELSE 0.0 END) FROM supplier), 9) AS missing_fraction",
)
def graph_profile(spark, sf):
    balance = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("string"))
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.create_map(F.lit("balance"), balance).alias("attrs"))
    return quality.profile_graph(nodes, roads(spark, sf)).withColumn("missing_fraction", F.round("missing_fraction", 9))
