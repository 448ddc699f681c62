"""Coverage by demand signature against coverage by demand row."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteplan.plans import scoring as s

PROBLEM = {"problem_id": "p", "evidence_id": "e", "family": "max_weighted_coverage", "site_limit": 9}


def evidence(spark, seed: int, places: int):
    """Demand in a few places, so that many rows are reached alike; two scenarios, failed sites, groups, repeated rows."""
    rng = random.Random(seed)
    place_of = {f"d{i}": rng.randrange(places) for i in range(120)}
    reach = [[(f"s{j}", rng.choice([0.0, 0.25, 0.5, 1.0])) for j in range(14) if rng.random() < 0.2] for _ in range(places)]
    rows = [("e", scen, d, site, b) for d, p in place_of.items() for scen in ("base", "storm") for site, b in reach[p]]
    rows += [(e, scen, d, site, b / 2) for e, scen, d, site, b in rows[::7]]
    service = spark.createDataFrame(rows, "evidence_id STRING, scenario STRING, demand_id STRING, site_id STRING, benefit DOUBLE")
    demand = spark.createDataFrame([("e", d, rng.choice([0.0, 1.0, 2.5, None])) for d in place_of], "evidence_id STRING, demand_id STRING, need DOUBLE")
    sites = spark.createDataFrame([("e", f"s{j}", 1.0, 9.0, True, False, 0.0, 0.0) for j in range(14)], "evidence_id STRING, site_id STRING, opening_cost DOUBLE, capacity DOUBLE, eligible BOOLEAN, existing BOOLEAN, x DOUBLE, y DOUBLE")
    scenarios = spark.createDataFrame([("e", "base", 0.6), ("e", "storm", 0.4)], "evidence_id STRING, scenario STRING, weight DOUBLE")
    multipliers = spark.createDataFrame([("e", "storm", f"d{i}", 3.0) for i in range(0, 120, 5)], "evidence_id STRING, scenario STRING, demand_id STRING, multiplier DOUBLE")
    failed = spark.createDataFrame([("e", "storm", "s3")], "evidence_id STRING, scenario STRING, site_id STRING")
    groups = spark.createDataFrame([("e", g, f"d{i}", share) for i in range(0, 120, 3) for g, share in (("a", 1.0), ("b", 0.5))][::2], "evidence_id STRING, group_name STRING, demand_id STRING, membership DOUBLE")
    return s.Evidence(demand, sites, service, scenarios, None, multipliers, failed, groups)


@pytest.mark.parametrize("seed, places", [(1, 6), (2, 40)])
def test_sums_equal_those_of_demand_rows(spark, seed, places):
    ev = evidence(spark, seed, places)
    rng = random.Random(seed)
    chosen = [(f"plan{k}", f"s{j}") for k in range(60) for j in rng.sample(range(16), rng.randint(0, 6))]
    rows = spark.createDataFrame(chosen + chosen[:5], "plan_id STRING, site_id STRING")
    plans = spark.createDataFrame([(f"plan{k}", "p") for k in range(60)], "plan_id STRING, problem_id STRING")
    problems = spark.createDataFrame([tuple(PROBLEM.get(f.split(" ")[0]) for f in s.PROBLEM_SCHEMA.split(", "))], s.PROBLEM_SCHEMA)
    covered = s.coverage(rows, plans, problems, ev)
    want = covered.groupBy("plan_id", "scenario", "pattern").agg(F.sum(F.col("coverage") * F.col("weight")).alias("w")).filter("w is not null")
    want = {r[:3]: r.w for r in want.collect()}
    got = {r[:3]: r["_covered"] for r in s.covered_sums(rows, plans, problems, ev).collect() if r["_covered"] is not None}
    assert {k: v for k, v in got.items() if v} == pytest.approx({k: v for k, v in want.items() if v})


def test_signatures_follow_places_not_demand(spark):
    ev = evidence(spark, 3, 5)
    rows = s.signatures(ev)
    groups = rows.select("scenario", "_h1", "_h2", "pattern").distinct().count()
    # Two scenarios, at most five places, at most three kinds of group shares.
    assert groups <= 2 * 5 * 3
    held = rows.groupBy("scenario", "_h1", "_h2", "pattern").agg(F.count("*").alias("n"), F.max("sharing").alias("sharing"))
    assert held.filter("n != sharing").isEmpty()


@pytest.mark.parametrize("seed, places", [(3, 6), (4, 40)])
def test_few_plans_meet_pairs_directly_with_the_same_sums(spark, monkeypatch, seed, places):
    ev = evidence(spark, seed, places)
    rows = spark.createDataFrame([(f"plan{j % 3}", f"s{j}") for j in range(16)], "plan_id STRING, site_id STRING")
    plans = spark.createDataFrame([(f"plan{k}", "p") for k in range(4)], "plan_id STRING, problem_id STRING")
    problems = spark.createDataFrame([("p", "e")], "problem_id STRING, evidence_id STRING")
    sums = lambda: {tuple(r)[:3]: round(r["_covered"], 9) for r in s.covered_sums(rows, plans, problems, ev).collect() if r["_covered"]}
    monkeypatch.setattr(s, "signatures", lambda ev: pytest.fail("pairs are few here"))
    direct = sums()
    monkeypatch.undo()
    monkeypatch.setattr(s, "FEW_PLANS", 0)
    assert direct and direct == sums()


def test_close_sites_are_met_without_keeping_pairs(spark, monkeypatch):
    """Pairs are packed, never kept one by one."""
    ev = evidence(spark, 5, 6)
    chosen = [(f"plan{k}", f"s{j}") for k in range(30) for j in range(14) if (j * 7 + k) % 3]
    rows = spark.createDataFrame(chosen, "plan_id STRING, site_id STRING")
    plans = spark.createDataFrame([(f"plan{k}", "p") for k in range(30)], "plan_id STRING, problem_id STRING")
    problems = spark.createDataFrame([("p", "e")], "problem_id STRING, evidence_id STRING")
    covered = s.coverage(rows, plans, problems, ev)
    want = covered.groupBy("plan_id", "scenario", "pattern").agg(F.sum(F.col("coverage") * F.col("weight")).alias("w")).collect()
    monkeypatch.setattr(s, "cut_lineage", lambda df: pytest.fail("pairs are not kept"))
    monkeypatch.setattr(s, "FEW_PLANS", 0)
    got = {r[:3]: r["_covered"] for r in s.covered_sums(rows, plans, problems, ev).collect() if r["_covered"]}
    assert got == pytest.approx({r[:3]: r.w for r in want if r.w})


@pytest.mark.parametrize("signs, sets", [(1, 1), (3, 100), (100, 2)])
def test_close_sites_meet_signatures_in_parts(spark, monkeypatch, signs, sets):
    """However signatures and sets of a hub are dealt out, a set counts twice what its sites share."""
    ev = evidence(spark, 6, 30)
    shared = s.signature_lists(ev).filter(F.size("sites") > 1)
    pairs = [("e", h, sorted(c)) for h in ("s0", "s1", "s2") for k in (2, 3) for c in itertools.combinations([f"s{j}" for j in range(6)], k)]
    asked = spark.createDataFrame(pairs, "evidence_id STRING, hub STRING, _set ARRAY<STRING>")
    monkeypatch.setattr(s, "HUB_SIGNATURES", signs)
    monkeypatch.setattr(s, "HUB_SETS", sets)
    got = {(r.hub, tuple(r["_set"]), r.scenario, r.pattern): r["_twice"] for r in s._counted_twice(shared, asked).collect()}
    want: dict = {}
    for r in shared.collect():
        held = dict(zip(r.sites, r.benefits))
        for _, hub, chosen in pairs:
            some = [held.get(site, 0.0) for site in chosen]
            if hub == r.hub and r.weight and sum(some) > max(some):
                key = hub, tuple(chosen), r.scenario, r.pattern
                want[key] = want.get(key, 0.0) + r.weight * (sum(some) - max(some))
    assert want and got == pytest.approx(want)


def test_matrices_are_cut_into_slices(monkeypatch):
    signs = pa.table({
        "scenario": ["a", "b", "a", "a", "b"], "pattern": ["-"] * 5, "weight": [1.0, 2.0, None, 4.0, 5.0],
        "sites": [[1, 2, 3], [1, 3], [1, 2], [2, 3], [1, 2, 3]], "benefits": [[0.5, 0.25, 1.0], [1.0, 0.5], [1.0, 1.0], [0.5, 0.75], [0.1, 0.2, 0.3]],
    })
    sets = pa.table({"evidence_id": ["e"] * 3, "hub": [1] * 3, "_set": [[2, 3], [1, 9], [1, 2, 3]]})
    schema = pa.schema([("evidence_id", pa.string()), ("hub", pa.int64()), ("_set", pa.list_(pa.int64())), ("scenario", pa.string()), ("pattern", pa.string()), ("_twice", pa.float64())])
    rows = lambda: sorted((r["_set"], r["scenario"], round(r["_twice"], 9)) for r in s._sums_of_sets(schema, signs, sets).to_pylist())
    want = [([1, 2, 3], "a", 2.75), ([1, 2, 3], "b", 2.5), ([2, 3], "a", 2.25), ([2, 3], "b", 1.0)]
    assert rows() == want
    monkeypatch.setattr(s, "CELLS", 4)
    assert rows() == want
