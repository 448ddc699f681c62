import json
import os
import subprocess
import sys
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteplan.operators import evaluation
from siteplan.sources.readers import RUN_EVENT_SCHEMA
from siteplan.streaming import journal

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("coverage_by_segment", "points_in_zones", "nearest_site", "normalized_parts", "plan_issues", "grid_report", "simulated_routes", "selection_digests", "lineage_sizes")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    key = lambda names, rows: sorted(tuple(repr(dict(zip(names, r))[c]) for c in sorted(names)) for r in rows)
    assert key(df.columns, df.collect()) == key(columns, cursor.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def journal_lines(rows):
    return "\n".join(json.dumps({"run_id": r, "sequence": q, "kind": k, "action_id": a, "action_generation": g, "timestamp": f"2025-01-01T00:00:{q:02d}Z", "relative_monotonic_ms": q * 100, "payload": "{}"}) for r, q, k, a, g in rows)


def drain(spark, stream, mode="append"):
    journal.use_typed_state(spark)
    name = "t" + uuid.uuid4().hex
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_ordered_ingest_and_stale_events(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(journal_lines([("r", 0, "action_admitted", "a", 1), ("r", 1, "tool_started", "a", 1), ("r", 3, "tool_failed", "a", 1)]))
    got = {r.sequence: r.accepted for r in drain(spark, journal.check_sequence(journal.stream_events(spark, str(folder))))}
    assert got == {0: True, 1: True, 3: False}
    (folder / "2.json").write_text(journal_lines([("r", 4, "tool_completed", "a", 1), ("r", 5, "tool_started", "a", 2)]))
    kept = sorted(r.sequence for r in drain(spark, journal.drop_stale(journal.stream_events(spark, str(folder)))))
    assert kept == [0, 1, 3]
    spent = drain(spark, journal.stream_latency(journal.stream_events(spark, str(folder)).filter("sequence < 4")))
    assert [(r.tool, r.latency_ms) for r in spent] == [("unknown", 200)]


def test_sequence_over_triggers(spark, tmp_path):
    """Events that come too early wait for the missing one; several triggers give what one gives, whatever the order."""
    cut = [[("r", 2, "c"), ("r", 0, "a"), ("s", 1, "b")], [("r", 4, "e"), ("r", 2, "c"), ("r", 1, "b")], [("r", 3, "d"), ("r", 0, "a"), ("t", 0, "a")]]
    kinds = "run_id STRING, sequence BIGINT, kind STRING"

    def found(parts, each):
        folder = tmp_path / f"in-{uuid.uuid4().hex}"
        folder.mkdir()
        for number, rows in enumerate(parts):
            (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "sequence", "kind"), r))) for r in rows))
            os.utime(folder / f"{number}.json", (1_000_000 + number, 1_000_000 + number))
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", each).json(str(folder))
        return [(r.run_id, r.sequence, r.accepted) for r in drain(spark, journal.check_sequence(stream, hold=True))]

    apart, whole = found(cut, 1), found([sum(cut, [])], 1)
    want = sorted([("r", q, True) for q in range(5)] + [("t", 0, True), ("r", 2, False), ("r", 0, False)])
    assert sorted(apart) == sorted(whole) == want
    assert [q for r, q, ok in apart if r == "r" and ok] == [0, 1, 2, 3, 4]


def test_latency_takes_the_latest_earlier_start(spark, tmp_path):
    kinds = ["tool_completed", "tool_started", "tool_started", "tool_completed", "tool_failed", "tool_started"]
    (tmp_path / "1.json").write_text(journal_lines([("r", q, k, "a", 1) for q, k in enumerate(kinds)]))
    got = drain(spark, journal.stream_latency(journal.stream_events(spark, str(tmp_path))))
    batch = evaluation.tool_latency(spark.read.schema(RUN_EVENT_SCHEMA).json(str(tmp_path)))
    row = lambda r: (r.run_id, r.action_id, r.action_generation, r.sequence, r.tool, r.latency_ms)
    assert sorted(map(row, got)) == sorted(map(row, batch.collect())) == [("r", "a", 1, 3, "unknown", 100)]


def test_replay(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "run_id STRING, sequence BIGINT")
    assert [r.sequence for r in journal.replay(rows, "a", 0).collect()] == [1]


def test_no_single_task_steps():
    """Library code keeps to reliable checkpoints and builds no cartesian products."""
    source = "".join(p.read_text() for p in (ROOT / "siteplan").rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin(", ".toPandas(", ".rdd"):
        assert word not in source, word
