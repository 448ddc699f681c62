import pytest
from pyspark.sql import functions as F

from siteplan.operators import evaluation, evidence, health, lineage, quality
from siteplan.operators.tables import apply_operator


def test_health(spark):
    rows = spark.createDataFrame([("a", 10, 100, 6, 60, 4, 40, False), ("b", 2, 50, 1, 25, 1, 25, True)], "id STRING, cases INT, population INT, y1 INT, y2 INT, o1 INT, o2 INT, hidden BOOLEAN")
    got = {r.id: r for r in health.health_rate(rows, "cases", "population", 1000, threshold=5, suppression=["hidden"]).collect()}
    assert got["a"].measure == pytest.approx(100) and got["b"].measure is None and got["b"].measure_suppressed
    got = [r.measure for r in health.age_standardized_rate(rows, [("y1", "y2", 0.5), ("o1", "o2", 0.5)], 1000).orderBy("id").collect()]
    assert got == pytest.approx([100, 40])
    bounds = health.health_count(rows, "cases", confidence=0.95).orderBy("id").first()
    assert bounds.measure_lower == pytest.approx(10 - 1.959963984540054 * 10**0.5)
    with pytest.raises(Exception, match="positive"):
        health.health_rate(rows.withColumn("population", F.lit(0)), "cases", "population").collect()


def test_demand_policies(spark):
    rows = spark.createDataFrame([("a", 100.0, "urban", False), ("b", None, "rural", True)], "id STRING, need DOUBLE, grp STRING, hidden BOOLEAN")
    build = lambda df, policy: evidence.build_demand(df, "id", ["need"], ["grp"], suppression=["hidden"], policy=policy)
    assert build(rows, "error").count() == 2
    open_rows = rows.withColumn("hidden", F.lit(False))
    assert build(open_rows, "drop").count() == 1
    assert sorted(r.need for r in build(open_rows, "zero").collect()) == [0.0, 100.0]
    with pytest.raises(Exception, match="unsuppressed"):
        build(open_rows, "error").collect()
    with pytest.raises(ValueError, match="unique"):
        build(rows.union(rows), "drop")
    with pytest.raises(ValueError, match="role"):
        evidence.build_demand(rows, "id", ["need"], ["need"])


def test_normalise_and_profile(spark):
    rows = spark.createDataFrame([(1, "same", 1.0, -73.99, 40.75), (2, " same ", 2.0, -73.98, 40.76), (3, " ", 3.0, 0.0, 0.0), (4, "x", 1.0, None, None)], "o INT, raw STRING, need DOUBLE, x DOUBLE, y DOUBLE")
    got = evidence.normalize(rows, ["o"], "raw", value_fields=["need"], factor=1000.0, source_crs="EPSG:4326", target_crs="EPSG:3857").orderBy("o").collect()
    assert [r.id for r in got] == ["same", "same-2", "record-000003"] and [r.need for r in got] == [1000, 2000, 3000]
    assert got[0].x == pytest.approx(-8236529.1, abs=1)
    same = spark.createDataFrame([(1.0, "S", 1.0, 1.0), (1.0, "*", 1.0, 1.0), (None, "suppressed", 2.0, 2.0), (2.0, "true", None, None)], "v DOUBLE, m STRING, x DOUBLE, y DOUBLE")
    p = quality.profile(same, ["m"], ["x", "y"]).first()
    assert (p.suppressed_count, p.duplicate_geometry_count, p.empty_geometry_count, p.missing_fraction) == (4, 1, 1, 0.125)


def test_curve_metrics(spark):
    curve = spark.createDataFrame([("r", 0, 1.0, 1), ("r", 9, 2.0, 2), ("q", 2, 9.0, 1), ("q", 2, 1.0, 2), ("q", 5, 3.0, 3)], "run STRING, resource INT, quality DOUBLE, pos INT").withColumn("h", F.lit(99))
    area = {r.run: r.auc for r in evaluation.log_auc(curve, ["run"], "resource", "quality", "pos", "h").collect()}
    assert area["r"] == pytest.approx(3 * 2.302585092994046)
    marks = spark.createDataFrame([("q", [0, 2, 4, 5, 9])], "run STRING, thresholds ARRAY<INT>")
    got = {r.threshold: r.quality for r in evaluation.quality_at(curve, ["run"], "resource", "quality", "pos", marks).collect()}
    assert got == {0: None, 2: 1.0, 4: 1.0, 5: 3.0, 9: 3.0}
    d = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v DOUBLE").agg(*evaluation.describe_ci("v", "v")).first()
    assert (d.v_mean, d.v_variance) == (2.0, 2.0) and d.v_ci95 == pytest.approx(1.96)
    back = curve.withColumn("pos", -F.col("pos"))
    with pytest.raises(Exception, match="ordered"):
        evaluation.log_auc(back, ["run"], "resource", "quality", "pos", "h").collect()


def test_lineage_and_contract(spark):
    catalog = spark.createDataFrame([("a", 1, ["b", "c"]), ("b", 2, ["d"]), ("c", 3, ["d"]), ("d", 4, ["a"])], "artifact_id STRING, byte_size BIGINT, parent_ids ARRAY<STRING>")
    seeds = spark.createDataFrame([("r", "b"), ("s", "d")], "run_id STRING, artifact_id STRING")
    got = {r.run_id: (r.artifact_count, r.artifact_bytes, r.largest_artifact_bytes) for r in lineage.lineage_closure(seeds, catalog).collect()}
    assert got == {"r": (4, 10, 4), "s": (4, 10, 4)}
    double = lambda df, by: df.select((F.col("id") * by).alias("v"))
    assert apply_operator(spark.range(3), double, "v BIGINT", by=2).count() == 3
    with pytest.raises(TypeError):
        apply_operator(spark.range(3), double, "v STRING", by=2)


def test_lineage_compares_with_known_rows_only_now_and_then(spark, monkeypatch):
    """A long chain that ends in a cycle, a short cut and a shared root: right sums, and few joins with all known rows."""
    size, chain = 21, {f"n{i}": [f"n{i + 1}"] for i in range(20)}
    chain["n20"] = ["n18"]
    chain["n3"] = ["n4", "n10", "n10"]
    catalog = spark.createDataFrame([(k, int(k[1:]) + 1, v) for k, v in chain.items()], "artifact_id string, byte_size long, parent_ids array<string>")
    seeds = spark.createDataFrame([("a", "n0"), ("b", "n12"), ("b", "n12"), ("b", "n2"), ("c", "n20")], "run_id string, artifact_id string")
    met = []
    join = type(catalog).join
    monkeypatch.setattr(type(catalog), "join", lambda self, other, on=None, how=None: (met.append(how), join(self, other, on, how))[1])
    got = {r.run_id: tuple(r)[1:] for r in lineage.lineage_closure(seeds, catalog).collect()}
    whole = sum(range(1, size + 1))
    assert got == {"a": (21, whole, 21), "b": (19, whole - 3, 21), "c": (3, 19 + 20 + 21, 21)}
    assert met.count("left_anti") <= 3
    rows = {(r.run_id, r.artifact_id) for r in lineage.lineage_members(seeds, catalog).collect()}
    assert {a for r, a in rows if r == "c"} == {"n18", "n19", "n20"} and len(rows) == 43
