import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.operators import access, evidence, graph, overlay


@pytest.fixture(scope="module")
def zones(spark):
    rows = spark.createDataFrame([("z1", 0.0, 0.0, 10.0, 10.0), ("z2", 10.0, 0.0, 20.0, 10.0)], "zone_id STRING, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE")
    return rows.select("zone_id", geo.box_rings("west", "south", "east", "north").alias("rings"))


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("p1", 2.0, 2.0, 2.0), ("p2", 3.0, 10.0, 5.0), ("p3", 5.0, 18.0, 5.0)], "point_id STRING, need DOUBLE, x DOUBLE, y DOUBLE")


def test_zonal_and_join(zones, points):
    sums = {r.zone_id: r.overlay_need_sum for r in overlay.zonal(zones, points, "zone_id", ["need"]).collect()}
    assert sums == {"z1": 5.0, "z2": 8.0}
    within = overlay.spatial_join(points, zones, "within").collect()
    assert sorted((r.point_id, r.overlay_zone_id) for r in within) == [("p1", "z1"), ("p3", "z2")]
    touching = overlay.spatial_join(points, zones, "touches").collect()
    assert sorted((r.point_id, r.overlay_zone_id) for r in touching) == [("p2", "z1"), ("p2", "z2")]
    covers = overlay.spatial_join(zones, points, "covers", left_kind="polygon").count()
    assert covers == 4
    assert sorted(r.point_id for r in overlay.in_area(points, zones, "within").collect()) == ["p1", "p2", "p3"]


def test_raster(spark, points, zones):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)], "band INT, row INT, col INT, value DOUBLE")
    header = {"a": 10, "b": 0, "c": 0, "d": 0, "e": -10, "f": 20}
    got = {r.point_id: r.overlay_band_1 for r in overlay.sample_raster(points, cells, header).collect()}
    assert got == {"p1": 3.0, "p2": 4.0, "p3": 4.0}
    assert {r.zone_id: r.value for r in overlay.zonal_raster(zones, cells, header, "zone_id").collect()} == {"z1": 3.0, "z2": 4.0}


def test_nearest_in_a_dense_cluster(spark):
    """A third of the sites share one small spot, far from most points."""
    rng = np.random.default_rng(3)
    sites = np.vstack([rng.normal(50, 0.001, (300, 2)), rng.random((600, 2)) * 1000])
    left = np.vstack([rng.random((200, 2)) * 1000, rng.normal(50, 5, (100, 2))])
    s = spark.createDataFrame(pd.DataFrame({"sid": range(len(sites)), "x": sites[:, 0], "y": sites[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"pid": range(len(left)), "x": left[:, 0], "y": left[:, 1]}))
    got = overlay.nearest(p, s, "pid", "sid", "sid").toPandas().sort_values("pid")
    distance = np.hypot(left[:, None, 0] - sites[None, :, 0], left[:, None, 1] - sites[None, :, 1])
    assert (got.overlay_sid.values == distance.argmin(1)).all()
    assert np.allclose(got.overlay_distance, distance.min(1))
    empty = overlay.nearest(p, s.filter("sid < 0"), "pid", "sid", "sid").first()
    assert empty.overlay_sid is None and empty.overlay_distance is None


@pytest.mark.parametrize("kind", ["left in one place", "right in one spot", "right in one place", "one axis", "far away", "ties"])
def test_nearest_of_uneven_points(spark, kind):
    rng = np.random.default_rng(9)
    sites, left = rng.random((1500, 2)) * 1000, rng.random((400, 2)) * 1000
    if kind == "left in one place":
        left[:] = [123.456, 654.321]
    elif kind == "right in one spot":
        sites[:1350] = 700 + rng.random((1350, 2)) * 1e-7
    elif kind == "right in one place":
        sites[:1350] = [1e-3, 2e-3]
    elif kind == "one axis":
        sites[:, 1] = 5.0
    elif kind == "far away":
        left = left * 1e6 - 5e8
        left[:200] = rng.random((200, 2)) * 1000 + [1e5, -1e5]
    else:
        sites, left = np.floor(sites / 50) * 50, np.floor(left / 25) * 25
    s = spark.createDataFrame(pd.DataFrame({"sid": range(len(sites)), "x": sites[:, 0], "y": sites[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"pid": range(len(left)), "x": left[:, 0], "y": left[:, 1]}))
    got = overlay.nearest(p, s, "pid", "sid", "sid").toPandas().sort_values("pid")
    across = left[:, None, :] - sites[None, :, :]
    distance = np.sqrt(across[..., 0] * across[..., 0] + across[..., 1] * across[..., 1])
    assert len(got) == len(left)
    assert (got.overlay_sid.values == distance.argmin(1)).all()
    assert np.allclose(got.overlay_distance, distance.min(1))


def test_large_polygon_has_inner_cells(spark):
    """A country-sized polygon with a hole: hundreds of cells, and pairs of inner ones are right without any edge."""
    rng = np.random.default_rng(21)
    angle = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    far = 400 + 80 * np.sin(5 * angle) + rng.uniform(-15, 15, 300)
    ring = [(float(500 + r * np.cos(t)), float(500 + r * np.sin(t))) for r, t in zip(far, angle, strict=True)]
    hole = [(450.0, 450.0), (450.0, 600.0), (620.0, 600.0), (620.0, 450.0)]
    small = [(10.0, 10.0), (12.0, 10.0), (12.0, 13.0)]
    shapes = [("big", [[*ring, ring[0]], [*hole, hole[0]]]), ("small", [[*small, small[0]]])]
    zones = spark.createDataFrame(shapes, "zone_id STRING, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    spots = np.vstack([rng.random((3000, 2)) * 1000, [[450, 500], [620, 600], [500, 500], [11, 11], [12, 13]], np.array(ring[:20])])
    points = spark.createDataFrame(pd.DataFrame({"pid": range(len(spots)), "x": spots[:, 0], "y": spots[:, 1]}))
    cells, _ = overlay.polygon_cells(zones, "rings")
    assert cells.filter("zone_id = 'big' and _inner").count() > 100 and cells.filter("zone_id = 'big' and not _inner").count() > 100
    pairs = overlay.pair_points_polygons(points, zones, "x", "y", "rings", keep_rings=True)
    assert pairs.groupBy("pid", "zone_id").count().filter("count > 1").isEmpty()
    inner = pairs.filter("_inner")
    assert inner.count() > 800
    assert inner.filter(~geo.point_polygon("x", "y", "rings", "within")).isEmpty()
    for predicate in ("within", "intersects", "touches"):
        got = overlay.spatial_join(points, zones, predicate).select("pid", "overlay_zone_id")
        brute = points.join(zones, F.lit(True)).filter(geo.point_polygon("x", "y", "rings", predicate)).select("pid", "zone_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))


def test_box_join_pairs_each_once(spark):
    rng = np.random.default_rng(10)

    def boxes(n):
        low, size = rng.random((n, 2)) * 100, np.exp(rng.uniform(-8, 5, (n, 2)))
        size[: n // 10] = 0
        return pd.DataFrame({"west": low[:, 0], "south": low[:, 1], "east": low[:, 0] + size[:, 0], "north": low[:, 1] + size[:, 1]})

    a, b = boxes(200), boxes(150)
    got = overlay.box_join(spark.createDataFrame(a.assign(i=range(200))), spark.createDataFrame(b.assign(j=range(150)))).select("i", "overlay_j").collect()
    meets = (
        (a.west.values[:, None] <= b.east.values) & (b.west.values <= a.east.values[:, None])
        & (a.south.values[:, None] <= b.north.values) & (b.south.values <= a.north.values[:, None])
    )
    assert sorted(map(tuple, got)) == sorted(zip(*map(list, np.nonzero(meets)), strict=True))


def test_pairs_near_poles_and_date_line(spark):
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(-180, 180, 300), np.concatenate([rng.uniform(80, 90, 150), rng.uniform(-90, 90, 150)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "lon": lon, "lat": lat}))
    o = df.select(F.col("i").alias("a"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    d = df.select(F.col("i").alias("b"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"))
    for km in (200.0, 3000.0, 15000.0):
        found = access.pairs_within_sphere(o, d, km).select("a", "b")
        brute = o.join(d, F.lit(True)).filter(geo.haversine("o_lon", "o_lat", "d_lon", "d_lat") <= km).select("a", "b")
        assert found.count() == brute.count() and found.exceptAll(brute).isEmpty()


def test_travel_strategies(spark):
    o = spark.createDataFrame([("o1", 0.0, 0.0), ("o2", 1000.0, 0.0)], "origin_id STRING, o_x DOUBLE, o_y DOUBLE")
    d = spark.createDataFrame([("d1", 1000.0, 0.0), ("d2", 2000.0, 0.0)], "destination_id STRING, d_x DOUBLE, d_y DOUBLE")
    table = access.travel_matrix(o, d, "euclidean", crs="EPSG:3857")
    assert sorted(r.travel for r in table.collect()) == [0.0, 1000.0, 1000.0, 2000.0]
    service = access.service_matrix(table, "binary_threshold", threshold=1000)
    assert sorted(r.benefit for r in service.collect()) == [0.0, 1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        access.travel_matrix(o, d, "euclidean")
    a = spark.createDataFrame([("a", 0.0, 0.0)], "origin_id STRING, o_x DOUBLE, o_y DOUBLE")
    b = spark.createDataFrame([("b", 1.0, 0.0)], "destination_id STRING, d_x DOUBLE, d_y DOUBLE")
    assert access.travel_matrix(a, b, "geodesic", "kilometers").first().travel == pytest.approx(111.319, rel=1e-4)
    bad = spark.createDataFrame([("a", 40.0, -120.0)], "origin_id STRING, o_x DOUBLE, o_y DOUBLE")
    with pytest.raises(Exception, match="axis reversal"):
        access.travel_matrix(bad, b, "haversine").collect()


def test_service_curves(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (12.0,), (math.inf,), (None,)], "a DOUBLE")
    got = [r[0] for r in df.select(access.service_benefit("a", "piecewise", knots=[(0, 1.0), (12, 0.0)])).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(7 / 12) and got[2:] == [0.0, 0.0, None]
    got = [r[0] for r in df.select(access.service_benefit("a", "exponential_decay", decay_scale=12)).collect()]
    assert got[2] == pytest.approx(math.exp(-1)) and got[3] == 0.0
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1.0,)], "a DOUBLE").select(access.service_benefit("a", "binary_threshold", threshold=1)).collect()


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "b", 9.0), ("b", "c", 7.0)], "src STRING, dst STRING, weight DOUBLE")
    o = spark.createDataFrame([("a", "a"), ("c", "c")], "origin_id STRING, node STRING")
    d = spark.createDataFrame([("a", "a"), ("c", "c")], "destination_id STRING, node STRING")
    table = access.travel_matrix(o, d, "graph_shortest_path", edges=edges)
    got = {(r.origin_id, r.destination_id): r.travel for r in table.collect()}
    assert got == {("a", "a"): 0.0, ("a", "c"): 12.0, ("c", "a"): math.inf, ("c", "c"): 0.0}
    assert access.unreachable_count(table).first()[0] == 1
    sets = graph.isochrone_sets(graph.isochrones(edges, o.filter("node = 'a'"), [5, 12])).collect()
    assert {r.cutoff: r.nodes for r in sets} == {5.0: ["a", "b"], 12.0: ["a", "b", "c"]}


def test_grid(spark):
    grid = evidence.grid_points(spark, (0, 0, 10, 5), 5).orderBy("site_id").collect()
    assert [(r.site_id, r.x, r.y) for r in grid][:4] == [("grid-000001", 0.0, 0.0), ("grid-000002", 5.0, 0.0), ("grid-000003", 10.0, 0.0), ("grid-000004", 0.0, 5.0)]
    assert len(grid) == 6


def test_sphere_pairs_are_spread_and_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    here = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150), strict=True))]
    there = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60), strict=True))]
    # Equal places, both poles, the date line and a pair at exactly the cutoff.
    here += [(900, *there[0][1:]), (901, 12.0, 90.0), (902, 180.0, 1.0), (903, 0.0, 0.0)]
    there += [(900, -100.0, 90.0), (901, -180.0, 1.0), (902, 0.0, 9.0)]
    o = spark.createDataFrame(here, "a LONG, o_lon DOUBLE, o_lat DOUBLE").coalesce(1)
    d = spark.createDataFrame(there, "b LONG, d_lon DOUBLE, d_lat DOUBLE").coalesce(1)
    every = o.crossJoin(d).select("a", "b", geo.haversine("o_lon", "o_lat", "d_lon", "d_lat").alias("km")).collect()
    at = next(r["km"] for r in every if (r["a"], r["b"]) == (903, 902))
    for cutoff in (0.0, 300.0, at, 1500.0, 12000.0, 21000.0):
        near = access.pairs_within_sphere(o, d, cutoff)
        assert sorted(tuple(r) for r in near.select("a", "b", "distance_km").collect()) == sorted(tuple(r) for r in every if r["km"] <= cutoff)
    assert near.columns == ["a", "o_lon", "o_lat", "b", "d_lon", "d_lat", "distance_km"]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
