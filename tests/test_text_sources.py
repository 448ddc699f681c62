import difflib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siteplan.functions import text
from siteplan.operators import cases
from siteplan.sources import parsers, readers, writers


def fold(value):
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def test_names(spark):
    names = ["Éclair  Straße!", "São-Paulo (BR)", "", "ﬁne"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r[0] for r in df.select(text.normalize_name("n")).collect()] == [fold(n) for n in names]
    assert df.select(text.location_id(F.lit("New York"), "n")).first()[0] == "new-york:eclair-strasse"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    for r in docs.select("text", text.normalize_name("text").alias("t")).collect():
        assert r.t == fold(r.text)


def test_name_search(spark):
    names = ["red bolt", "red bolts", "blue gear", "old ring"]
    places = spark.createDataFrame([("c", n, n, n) for n in names], "case_id STRING, location_id STRING, name STRING, normalized STRING")
    asked = ["red bolt", "red blt", "gear", "zzz", "old rin"]
    queries = spark.createDataFrame([("c", i, q, q) for i, q in enumerate(asked)], "case_id STRING, ord INT, query STRING, normalized STRING")
    got = {}
    for r in cases.search_names(queries, places).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.name, round(r.score, 6)))
    for q in asked:
        score = lambda n: 1.0 if n == q else 0.9 if q in n or n in q else difflib.SequenceMatcher(None, q, n).ratio()
        want = sorted(((n, round(score(n), 6)) for n in names if score(n) >= 0.35), key=lambda e: (-e[1], e[0]))[:5]
        assert got.get(q, []) == want, q
    status = {r.query: (r.status, r.location_id) for r in cases.resolve_names(queries, places).collect()}
    assert status["gear"] == ("resolved", "blue gear") and status["zzz"] == ("unknown", None) and status["red blt"][0] == "repeated"


def test_redaction(spark):
    urls = {
        "https://u:p@Host.org:8080/a/b?token=1&x=a%20b&empty=#f": "https://host.org:8080/a/b?token=%5BREDACTED%5D&x=a+b",
        "http://h/p": "http://h/p",
        "http://h/p?design=1": "http://h/p?design=%5BREDACTED%5D",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    assert [r[0] for r in df.select(text.redact_url("u")).collect()] == list(urls.values())
    blob = json.dumps({"a": [{"My_Token": 1, "b": "é"}], "cookie": {"x": 1}})
    got = json.loads(spark.createDataFrame([(blob,)], "j STRING").select(text.redact_json("j")).first()[0])
    assert got == {"a": [{"My_Token": "[redacted]", "b": "é"}], "cookie": "[redacted]"}


def test_budgets_and_times(spark):
    df = spark.createDataFrame([("30s,500ms, 2m,1h,unlimited,30", "32k,1_000,1m,none")], "t STRING, k STRING")
    row = df.select(text.parse_time_budget("t"), text.parse_token_budget("k")).first()
    assert row[0] == [30.0, 0.5, 120.0, 3600.0, None] and row[1] == [32000, 1000, 1000000, None]
    with pytest.raises(Exception, match="invalid"):
        spark.createDataFrame([("3x",)], "t STRING").select(text.parse_time_budget("t")).collect()
    with pytest.raises(Exception, match="time zone"):
        spark.createDataFrame([("2025-01-01T00:00:00",)], "t STRING").select(text.parse_utc("t")).collect()


def test_geojson_graph_matrix(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "a", "n": 1}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"id": "b", "n": None}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}},
        {"type": "Feature", "properties": {"id": "c", "n": 3}, "geometry": None}]}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(doc))
    rows = {r.id: r for r in readers.read_geojson(spark, str(path)).collect()}
    assert (rows["a"].x, rows["a"].y, rows["a"].n) == (1.5, 2.5, 1) and len(rows["b"].rings[0]) == 4 and rows["c"].x is None
    assert [r.id for r in readers.read_geojson(spark, str(path), bbox=(1, 1, 5, 5)).collect()] == ["a", "b"]
    path.write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(Exception):
        readers.read_geojson(spark, str(path), properties="id STRING").collect()
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"directed": False, "multigraph": False, "nodes": [{"id": 1, "x": 2}, {"id": 2}], "edges": [{"source": 1, "target": 2, "attributes": {"minutes": 5}}]}))
    nodes, edges = readers.read_graph(spark, str(g))
    assert sorted((r.src, r.dst, r.weight) for r in readers.path_edges(edges, "minutes").collect()) == [("1", "2", 5.0), ("2", "1", 5.0)]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"row_ids": ["a", "b"], "column_ids": ["x"], "values": [[1.0], [None]]}))
    assert sorted((r.row_id, r.row_ord, r.value) for r in readers.read_matrix(spark, str(m)).collect()) == [("a", 0, 1.0), ("b", 1, None)]
    m.write_text(json.dumps({"row_ids": ["a", "a"], "column_ids": ["x"], "values": [[1.0], [2.0]]}))
    with pytest.raises(Exception, match="unique"):
        readers.read_matrix(spark, str(m)).collect()


def test_csv_cases_events_region(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,lon,lat\na,1,1\nb,bad,1\nc,50,1\n")
    assert [r.id for r in readers.read_csv_points(spark, str(tmp_path / "p.csv"), "lon", "lat", (0, 0, 10, 10), ["id"]).collect()] == ["a"]
    case = {"prompt": "p", "geographic_region": "R", "locations": [{"name": "A", "latitude": 1.0, "longitude": 2.0, "population": 5}, {"name": "a!", "latitude": 1.0, "longitude": 200.0}], "answer": {"x": 1}, "coverage_radius_km": 3.0}
    (tmp_path / "c.json").write_text(json.dumps([case]))
    head, places = readers.read_cases(spark, str(tmp_path / "c.json"), "max_coverage")
    codes = {r.code for r in readers.case_issues(head, places).collect()}
    assert codes == {"missing_centers", "bad_coordinates", "missing_population", "repeated_location"}
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"run_id": r, "sequence": q}) for r, q in [("a", 0), ("a", 1), ("b", 0), ("b", 2)]))
    assert [r.run_id for r in readers.event_gaps(readers.read_events(spark, str(tmp_path / "e.json"))).collect()] == ["b"]
    (tmp_path / "north-bay-0a1b2c3d.json").write_text(json.dumps({"locations": [{"name": "A", "latitude": 1, "longitude": 2}, {"name": "B", "latitude": 1, "longitude": 3}], "distances_m": [[0, 5], [6, 0]]}))
    rows = readers.read_region_matrix(spark, str(tmp_path / "north-bay-0a1b2c3d.json")).collect()
    assert {(r.region, r.from_name, r.to_name): r.meters for r in rows}[("north-bay", "B", "A")] == 6.0


def test_sinks(spark, tmp_path):
    sites = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 4.0)], "site_id STRING, x DOUBLE, y DOUBLE")
    writers.write_geojson(sites, sites.filter("site_id = 'a'"), str(tmp_path / "map"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "map")).collect()]
    assert sorted((f["properties"]["site_id"], f["properties"]["selected"]) for f in lines) == [("a", True), ("b", False)]
    summary = sites.select("site_id", F.create_map(F.lit("z"), "x", F.lit("k"), "y").alias("m"), F.array("site_id").alias("keys"))
    writers.write_aggregates(sites.withColumn("run_key", F.col("site_id")), summary, str(tmp_path / "out"))
    flat = spark.read.parquet(str(tmp_path / "out/aggregate_parquet")).orderBy("site_id").first()
    assert flat.m == '{"k":4.0,"z":3.0}' and flat["keys"] == "a"
    batch = spark.createDataFrame([(bytearray(b"x"), "1"), (bytearray(b"x"), "1"), (bytearray(b"y"), "1"), (bytearray(b"y"), "2")], "content BINARY, lic STRING")
    known = batch.select(writers.content_id().alias("artifact_id"), "lic").limit(0)
    fresh, clash = writers.publish(batch, known, ["lic"])
    assert fresh.count() == 1 and clash.count() == 1


def test_exact_cases(spark):
    places = spark.createDataFrame([(1, i, f"p{i}", float(i * 2), 0.0, p) for i, p in enumerate([5, 1, 7, 3])] , "case_id INT, ord INT, name STRING, longitude DOUBLE, latitude DOUBLE, population BIGINT")
    one = spark.createDataFrame([(1, 2, 250.0, 90.0)], "case_id INT, centers INT, radius_km DOUBLE, target_percent DOUBLE")
    best = cases.solve_max_coverage(places, one).first()
    assert best.people_covered == 16 and best.center_locations == ["p0", "p2"] and best.optimal_solution_count == 4
    few = cases.solve_minimum_facility(places, one).first()
    assert (few.minimum_centers, few.people_covered, few.target_population) == (2, 16, 15)
    many = spark.createDataFrame([(2, i, f"q{i}", float(i * 10), 0.0, 1) for i in range(17)], "case_id INT, ord INT, name STRING, longitude DOUBLE, latitude DOUBLE, population BIGINT")
    wide = spark.createDataFrame([(2, 2, 50.0, 10.0)], "case_id INT, centers INT, radius_km DOUBLE, target_percent DOUBLE")
    big = cases.solve_max_coverage(many, wide).first()
    assert (big.people_covered, big.optimal_solution_count, big.center_locations) == (2, 136, ["q0", "q1"])
    assert cases.solve_minimum_facility(many, wide).first().minimum_centers == 2
