"""Queries whose cost once grew faster than their input."""

import itertools
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siteplan.operators import access, evaluation, ordered
from siteplan.plans import scoring, validation
from siteplan.streaming import journal


class Counted:
    """A state whose calls are counted, as each is a trip to the JVM."""

    def __init__(self, calls):
        self.calls, self.value, self.rows = calls, None, {}

    def __getattribute__(self, name):
        if name not in ("calls", "value", "rows"):
            object.__getattribute__(self, "calls").append(name)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None or bool(self.rows)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        return iter(self.rows.items())

    def clear(self):
        self.rows.clear()


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):
        return Counted(self.calls)

    getMapState = getValueState


def taken(step, *sequences):
    rows = [Row(run_id="r", sequence=q, kind=f"k{q}") for q in sequences]
    return sorted((r.sequence, r.kind, r.accepted) for r in step.handleInputRows(("r",), iter(rows), None))


def test_sequence_asks_its_state_once_per_trigger():
    step, handle = journal._Sequence(False), Handle()
    step.init(handle)
    found = taken(step, *range(5), *range(6, 40), 6)
    assert [q for q, _, ok in found if ok] == list(range(5)) and len(found) == 40
    assert len(handle.calls) <= 3
    assert taken(step, 6, 5) == [(5, "k5", True), (6, "k6", True)]


def test_sequence_with_hold_keeps_early_rows():
    step = journal._Sequence(True)
    step.init(Handle())
    assert taken(step, 0, 2, 4, 2) == [(0, "k0", True), (2, "k2", False)]
    assert taken(step, 3, 4) == [(4, "k4", False)]
    assert taken(step, 1) == [(q, f"k{q}", True) for q in (1, 2, 3, 4)]
    assert taken(step, 5, 4) == [(4, "k4", False), (5, "k5", True)]


def test_group_quantiles_meet_every_group_by_rank(spark):
    rows = [("ab"[i % 2] if i % 7 else None, "xy"[i % 3 // 2], float(i * 37 % 101) if i % 5 else None if i % 10 else 50.0) for i in range(600)]
    rows += [("a", "x", math.nan), ("c", "x", -5.0)]
    df = spark.createDataFrame(rows, "dataset STRING, budget_id STRING, v DOUBLE")
    found = ordered.group_quantiles(df, ["dataset", "budget_id"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}, evaluation._levels, evaluation.LEVEL)
    got = {tuple(r[:3]): r[3:] for r in found.collect()}
    groups = {}
    for d, b, v in rows:
        for at in (("overall", "*", "*"), ("dataset", d, "*"), ("budget", "*", b), ("dataset_budget", d, b)):
            if v is not None:
                groups.setdefault(at, []).append(v)
    pick = lambda vs, q: sorted(vs, key=lambda v: (math.isnan(v), v))[round(q * (len(vs) - 1))]
    assert {k: [str(v) for v in r] for k, r in got.items()} == {k: [str(pick(vs, q)) for q in (0.5, 0.95, 1.0)] for k, vs in groups.items()}
    assert ordered.group_quantiles(df.filter("false"), ["dataset", "budget_id"], "v", {"p": 0.5}, evaluation._levels, evaluation.LEVEL).count() == 0


def test_allocation_rules_read_joined_arcs_once(spark):
    world = lambda rows, layout: spark.createDataFrame(rows, layout).withColumn("evidence_id", F.lit("w"))
    need = world([(1, 10.0), (2, 5.0)], "demand_id INT, need DOUBLE")
    sites = world([(7, 8.0, True), (8, 100.0, True)], "site_id INT, capacity DOUBLE, existing BOOLEAN")
    reach = world([("storm", 1, 7, math.inf), ("base", 1, 7, 3.0), ("base", 2, 8, math.inf)], "scenario STRING, demand_id INT, site_id INT, access DOUBLE")
    ev = scoring.Evidence(need, sites, None, None, reach)
    problems = spark.createDataFrame([("p", "w")], "problem_id STRING, evidence_id STRING")
    plans = spark.createDataFrame([("ok", "p"), ("bad", "p"), ("far", "p")], "plan_id STRING, problem_id STRING")
    chosen = spark.createDataFrame(list(itertools.product(("ok", "bad", "far"), (7, 8))), "plan_id STRING, site_id INT")
    rows = [("ok", 1, 7, 8.0), ("bad", 1, 7, 9.0), ("bad", 1, 7, 2.0), ("bad", 3, 7, 1.0), ("bad", 1, 9, -1.0), ("far", 2, 8, 1.0), ("far", 1, 7, math.nan)]
    amounts = spark.createDataFrame(rows, "plan_id STRING, demand_id INT, site_id INT, amount DOUBLE")
    issues = validation.validate_allocations(amounts, chosen, plans, problems, ev)
    assert "Join" not in issues._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, issues.collect())) == [
        ("bad", "capacity_exceeded"), ("bad", "duplicate_allocation"), ("bad", "invalid_allocation_arc"),
        ("far", "invalid_allocation_amount"), ("far", "unreachable_allocation"),
    ]


def test_ellipsoid_pairs_cost_no_sphere_distance(spark):
    spots = [(i, i * 3.7 % 360 - 180, i * 1.9 % 176 - 88) for i in range(120)]
    o = spark.createDataFrame(spots, "origin_id INT, o_x DOUBLE, o_y DOUBLE")
    d = spark.createDataFrame([(i, x + 0.01, y) for i, x, y in spots if x < 179], "destination_id INT, d_x DOUBLE, d_y DOUBLE")
    near = access.travel_matrix(o, d, "geodesic", "kilometers", cutoff=900.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "ASIN(" not in plan.split("Join Inner")[0] + plan.split("Join Inner")[1].split("\n")[0]
    every = access.travel_matrix(o, d, "geodesic", "kilometers").filter("travel <= 900")
    got, wanted = ({tuple(r[:2]): r.travel for r in t.collect()} for t in (near, every))
    assert got == pytest.approx(wanted, rel=1e-9) and len(got) > 100


def test_planar_pairs_are_dealt_out_not_broadcast(spark):
    spots = [(i, i * 37.0 % 211, i * 53.0 % 197) for i in range(150)] + [(150, None, 1.0)]
    o = spark.createDataFrame(spots, "origin_id INT, o_x DOUBLE, o_y DOUBLE")
    d = spark.createDataFrame(spots, "destination_id INT, d_x DOUBLE, d_y DOUBLE")
    near = access.pairs_within_plane(o, d, 20.0)
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.origin_id, r.destination_id) for r in near.collect())
    assert got == sorted((a[0], b[0]) for a in spots[:-1] for b in spots[:-1] if math.hypot(a[1] - b[1], a[2] - b[2]) <= 20.0)
