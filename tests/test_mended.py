"""Cases that earlier versions got wrong."""

import json

import pytest
from pyspark.sql import functions as F

from siteplan.functions import geo, text
from siteplan.operators import cases, evidence, overlay
from siteplan.sources.parsers import materialize_locations


def boxes(spark, *sides):
    return spark.createDataFrame(list(sides), "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE").select(geo.box_rings("west", "south", "east", "north").alias("rings"))


def inside(spark, areas, *spots):
    points = spark.createDataFrame([(float(x), float(y)) for x, y in spots], "x DOUBLE, y DOUBLE")
    return sorted((r.x, r.y) for r in overlay.in_area(points, areas).collect())


def test_union_of_areas_keeps_only_what_it_surrounds(spark):
    two = boxes(spark, (0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0))
    assert inside(spark, two, (10, 5), (10, 0), (10, 10), (0, 0), (5, 5), (20, 5), (30, 5)) == [(5, 5), (10, 5)]
    same = boxes(spark, (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0))
    assert inside(spark, same, (0, 5), (0, 0), (10, 10), (1, 1)) == [(1, 1)]
    four = boxes(spark, (0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0), (0.0, 1.0, 1.0, 2.0), (1.0, 1.0, 2.0, 2.0))
    assert inside(spark, four, (1, 1), (1, 0), (1, 2)) == [(1, 1)]
    three = boxes(spark, (0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0), (0.0, 1.0, 1.0, 2.0))
    assert inside(spark, three, (1, 1)) == []


def test_grid_ids_have_no_gaps(spark):
    rows = evidence.grid_points(spark, (0, 0, 0.3, 0.3), 0.1).orderBy("site_id").collect()
    assert [r.site_id for r in rows] == [f"grid-{i + 1:06d}" for i in range(9)]
    assert max(r.x for r in rows) <= 0.3


def test_json_path_tells_null_from_absent(spark):
    rows = spark.createDataFrame([('{"a": {"b": null, "c": [1, null]}}',)], "j STRING")
    assert rows.select(text.json_path("j", ["a", "b"])).first()[0] is None
    assert rows.select(text.json_path("j", ["a", "c", 1])).first()[0] is None
    assert rows.select(text.json_path("j", ["a", "c", 0])).first()[0] == "1"
    for path in (["a", "x"], ["a", "c", 2], ["x", "b"]):
        with pytest.raises(Exception, match="path not found"):
            rows.select(text.json_path("j", path)).collect()


def test_sensitive_keys_are_keys_only(spark):
    told = {
        r'{"text":"say \"token\": x"}': False, r'{"token":1}': True, '{"a":[{"Api_Key" : 1}]}': True, '{"a":"token"}': False,
        '{"a\\"secret":1}': True, "{}": False, '["token"]': False, '{"x":"a:","cookies":{}}': True,
    }
    rows = spark.createDataFrame([(k,) for k in told], "j STRING").select("j", text.has_sensitive_json_key("j").alias("s"))
    assert {r.j: r.s for r in rows.collect()} == told


def test_redaction_at_every_depth(spark):
    given = {"k": 1, "auth": {"api_key": {"token": "x"}, "user": [1, {"MyPassword": 2, "é": None}]}, "list": [[{"cookie": 1}]]}
    shown = spark.createDataFrame([(json.dumps(given),), (None,)], "j STRING").select(text.redact_json("j")).collect()
    want = {"k": 1, "auth": {"api_key": "[redacted]", "user": [1, {"MyPassword": "[redacted]", "é": None}]}, "list": [[{"cookie": "[redacted]"}]]}
    assert json.loads(shown[0][0]) == want and shown[1][0] is None


def test_nan_hashes_as_null(spark):
    rows = spark.createDataFrame([(1, float("nan"), "NaN"), (1, None, "NaN"), (1, 2.0, "NaN")], "a INT, b DOUBLE, c STRING")
    hashes = [r[0] for r in rows.select(text.canonical_hash(["a", "b", "c"])).collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_tree_digest_sees_every_row(spark):
    rows = [(i, f"id{i}") for i in range(40)]
    changed = rows[:-1] + [(39, "other")]
    digest = lambda r: cases.tree_digest(spark.createDataFrame([("k", *x) for x in r], "key STRING, ord INT, record_id STRING"), ["key"], "record_id", "ord", block=2).collect()
    a, b = digest(rows), digest(changed)
    assert len(a) == len(b) == 1 and a[0].tree_digest != b[0].tree_digest


def test_last_name_of_a_repeated_place(spark):
    rows = spark.createDataFrame([("p", "Old", 1.0, 2.0, 1), ("p", "New", 1.0, 2.0, 2)], "provider_id STRING, display_name STRING, longitude DOUBLE, latitude DOUBLE, seen INT")
    rows = rows.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    assert materialize_locations(rows, ["p"], order="seen").first()["name"] == "New"


def test_cases_of_eighty_places(spark):
    places = [("c", i, f"p{i}", float(i), 0.0, i) for i in range(80)]
    frame = spark.createDataFrame(places, "case_id STRING, ord INT, name STRING, longitude DOUBLE, latitude DOUBLE, population BIGINT")
    asked = spark.createDataFrame([("c", 1, 120.0, 2.0)], "case_id STRING, centers INT, radius_km DOUBLE, target_percent DOUBLE")
    best = cases.solve_max_coverage(frame, asked).first()
    assert (best.people_covered, best.optimal_solution_count, best.center_locations) == (77 + 78 + 79, 1, ["p78"])
    fewest = cases.solve_minimum_facility(frame, asked).first()
    shown = (fewest.minimum_centers, fewest.people_covered, fewest.target_population, fewest.optimal_solution_count, fewest.center_locations)
    assert shown == (1, 21 + 22 + 23, 64, 58, ["p22"])


def test_order_places_are_ranked_in_one_shuffle(spark, tmp_path):
    """Places are dealt out by case alone; null cases and unknown sites stay out, a place counts once."""
    from siteplan.workloads.cases import order_places

    lines = [(7, 3, 2.0), (7, 1, 1.0), (7, 3, 5.0), (8, 2, 4.0), (None, 1, 9.0), (8, 99, 1.0), (9, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey LONG, l_suppkey LONG, l_quantity DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 0) for k in (1, 2, 3)], "s_suppkey LONG, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    places = order_places(spark, str(tmp_path))
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.case_id, r.ord, r.name, r.population) for r in places.collect()) == [(7, 0, "1", 1), (7, 1, "3", 7), (8, 0, "2", 4)]


def test_fewest_centers_of_every_size(spark):
    """Places too far apart to share a center: as many centers as the target asks for, in all ways."""
    from math import comb

    frame = spark.createDataFrame([("c", i, f"n{i}", 30.0 * i, 0.0, 1) for i in range(7)], "case_id STRING, ord INT, name STRING, longitude DOUBLE, latitude DOUBLE, population INT")
    asked = spark.createDataFrame([("c", 100.0 * 4 / 7 - 1e-6, 10.0)], "case_id STRING, target_percent DOUBLE, radius_km DOUBLE")
    got = cases.solve_minimum_facility(frame, asked).first()
    assert (got.minimum_centers, got.optimal_solution_count, got.center_locations) == (4, comb(7, 4), ["n0", "n1", "n2", "n3"])


def test_close_sites_are_dealt_out_once(spark):
    """Every pair closer than the spacing once, whatever grid it meets in; rows are not copied before they are moved."""
    import random

    from siteplan.plans import scoring, validation

    rng = random.Random(4)
    spots = {i: (rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(120)}
    sites = spark.createDataFrame([("e", i, x, y) for i, (x, y) in spots.items()], "evidence_id STRING, site_id INT, x DOUBLE, y DOUBLE")
    rows = spark.createDataFrame([(i % 2, i) for i in spots] + [(0, 2), (0, 999)], "plan_id INT, site_id INT")
    plans = spark.createDataFrame([(0, "p"), (1, "p"), (2, "p")], "plan_id INT, problem_id STRING")
    problems = spark.createDataFrame([("p", "e", 3.0)], "problem_id STRING, evidence_id STRING, minimum_spacing DOUBLE")
    found = validation.spacing_violations(rows, plans, problems, scoring.Evidence(sites, sites, sites, sites))
    near = lambda a, b: ((spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2) ** 0.5 + 1e-9 < 3.0
    want = sorted((a % 2, a, b) for a in spots for b in spots if a < b and a % 2 == b % 2 and near(a, b))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(tuple(r)[:3] for r in found.collect()) == want and "RepartitionByExpression" not in plan and "Generate" not in plan
