"""Run journals built from the event table: latency, profiles, curves, lineage, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteplan.functions import text
from siteplan.operators import evaluation, lineage, ordered
from siteplan.session import ensure_checkpoint_dir
from siteplan.sources import readers
from siteplan.streaming import journal
from siteplan.workloads import query
from siteplan.workloads.base import table

# A user is a run; its events in time order are the journal. Types stand for controller events.
JOURNAL_SQL = """j0 AS (SELECT user_id, event_id, event_type, value, props, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events),
j AS (SELECT CAST(user_id AS VARCHAR) AS run_id, sequence, event_id, value, ts,
  CASE event_type WHEN 'view' THEN 'tool_started' WHEN 'click' THEN 'tool_completed' WHEN 'error' THEN 'tool_failed' WHEN 'purchase' THEN 'incumbent_committed' ELSE 'candidate_rejected' END AS kind,
  CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, 'a' || CAST(event_id % 2 AS VARCHAR) AS action_id, CAST(1 AS BIGINT) AS gen, 't' || CAST(event_id % 5 AS VARCHAR) AS tool,
  CASE WHEN event_id % 3 = 0 THEN 'validation_failed' ELSE 'not_better' END AS reason, CAST(sequence * 10 AS BIGINT) AS tokens FROM j0)"""


def journal_table(spark, sf):
    numbered = ordered.positions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], name="_p")
    e = F.col("event_type")
    kind = (
        F.when(e == "view", "tool_started").when(e == "click", "tool_completed").when(e == "error", "tool_failed")
        .when(e == "purchase", "incumbent_committed").otherwise("candidate_rejected")
    )
    sequence = F.col("_p") - 1
    budget = lambda step: F.to_json(F.struct(
        (step * 10).alias("total_tokens"), (step * 7).alias("input_tokens"), (step * 3).alias("generated_tokens"), step.alias("tool_calls")
    ))
    tool = F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))
    reason = F.when(F.col("event_id") % 3 == 0, "validation_failed").otherwise("not_better")
    return numbered.select(
        F.col("user_id").cast("string").alias("run_id"), sequence.alias("sequence"), kind.alias("kind"), F.lit("searching").alias("state"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("relative_monotonic_ms"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")).alias("action_id"), F.lit(1).cast("bigint").alias("action_generation"),
        F.lit("model").alias("actor"), budget(F.greatest(sequence - 1, F.lit(0))).alias("budget_before"), budget(sequence).alias("budget_after"),
        F.array(F.concat(F.lit("plan-"), F.col("event_id").cast("string"))).alias("artifact_ids"),
        F.to_json(F.struct(tool.alias("tool"), reason.alias("reason"))).alias("payload"), "event_id", "value",
    )


LATENCY_SQL = """calls AS (SELECT *, lag(kind) OVER w AS pk, lag(ms) OVER w AS pms, lag(tool) OVER w AS pt FROM j WHERE kind IN ('tool_started', 'tool_completed', 'tool_failed')
  WINDOW w AS (PARTITION BY run_id, action_id, gen ORDER BY sequence)),
lat AS (SELECT run_id, action_id, sequence, pt AS tool, greatest(ms - pms, 0) AS latency_ms FROM calls WHERE kind <> 'tool_started' AND pk = 'tool_started')"""


@query("tool_latencies", "WITH " + JOURNAL_SQL + ", " + LATENCY_SQL + " SELECT run_id, action_id, CAST(sequence AS BIGINT) AS sequence, tool, CAST(latency_ms AS BIGINT) AS latency_ms FROM lat")
def tool_latencies(spark, sf):
    """Start and end events of tool calls, paired once each."""
    return evaluation.tool_latency(journal_table(spark, sf)).select("run_id", "action_id", "sequence", "tool", "latency_ms")


@query(
    "tool_latency_profile",
    "WITH " + JOURNAL_SQL + ", " + LATENCY_SQL + """, r AS (SELECT tool, latency_ms, row_number() OVER (PARTITION BY tool ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM lat)
SELECT tool, max(n) AS observations, CAST(min(latency_ms) FILTER (WHERE i = greatest(0, CAST(ceil(0.5 * n) AS BIGINT) - 1)) AS BIGINT) AS measured_p50_ms,
  CAST(min(latency_ms) FILTER (WHERE i = greatest(0, CAST(ceil(0.95 * n) AS BIGINT) - 1)) AS BIGINT) AS measured_p95_ms,
  min(latency_ms) FILTER (WHERE i = greatest(0, CAST(ceil(0.95 * n) AS BIGINT) - 1)) <= 100000000 AS within_declared_p95 FROM r GROUP BY tool""",
)
def tool_latency_profile(spark, sf):
    lat = evaluation.tool_latency(journal_table(spark, sf))
    declared = lat.select("tool").distinct().select("tool", F.lit(1000).alias("declared_p50_ms"), F.lit(100000000).alias("declared_p95_ms"))
    return evaluation.latency_profile(lat, declared).drop("declared_p50_ms", "declared_p95_ms")


@query(
    "run_event_profile",
    "WITH " + JOURNAL_SQL + """ SELECT run_id, count(*) FILTER (WHERE kind = 'candidate_rejected') AS rejected_candidates,
  count(*) FILTER (WHERE kind = 'candidate_rejected' AND reason = 'validation_failed') AS invalid_candidates, count(*) FILTER (WHERE kind = 'tool_failed') AS tool_failures, CAST(max(sequence) AS BIGINT) AS tool_calls FROM j GROUP BY 1""",
)
def run_event_profile(spark, sf):
    found = evaluation.event_profile(journal_table(spark, sf))
    return found.select("run_id", "rejected_candidates", "invalid_candidates", "tool_failures", "tool_calls")


@query(
    "commit_checkpoints",
    "WITH " + JOURNAL_SQL + """, inc AS (SELECT run_id, sequence, event_id, CASE WHEN kind = 'incumbent_committed' THEN tokens END AS tk FROM j WHERE kind IN ('incumbent_committed', 'candidate_rejected'))
SELECT run_id, CAST(sequence AS BIGINT) AS position, coalesce(max(tk) OVER (PARTITION BY run_id ORDER BY sequence), 0) AS total_model_tokens FROM inc""",
)
def commit_checkpoints(spark, sf):
    """Token use at each incumbent's commit; incumbents without a commit carry the last one forward."""
    events = journal_table(spark, sf)
    incumbents = events.filter(F.col("kind").isin("incumbent_committed", "candidate_rejected")).select(
        "run_id", F.col("sequence").alias("position"), F.concat(F.lit("plan-"), F.col("event_id").cast("string")).alias("plan_artifact_id")
    )
    return evaluation.checkpoints(incumbents, events).select("run_id", "position", "total_model_tokens")


@query(
    "improving_values",
    """WITH s AS (SELECT user_id, event_id, value, max(round(value, 9)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE event_type <> 'error')
SELECT user_id, event_id, value FROM s WHERE best IS NULL OR round(value, 9) > best""",
)
def improving_values(spark, sf):
    """Monotone incumbents per user over non-error events."""
    from siteplan.plans.search import incumbent_timeline

    rows = table(spark, sf, "events").withColumns({"feasible": F.col("event_type") != "error", "comparator": F.array("value"), "o": F.struct("ts", "event_id")})
    return incumbent_timeline(rows, ["user_id"], "o").select("user_id", "event_id", "value")


CURVE_SQL = """c AS (SELECT user_id, ts, event_id, value, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 2 AS BIGINT) AS resource, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""


def curve(spark, sf):
    rows = ordered.positions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], name="pos")
    return rows.select("user_id", "value", "pos", F.floor(F.col("pos") / 2).alias("resource"))


@query(
    "quality_curve_area",
    "WITH " + CURVE_SQL + """, d AS (SELECT user_id, resource, arg_max(value, pos) AS q FROM c GROUP BY ALL), n AS (SELECT *, lead(resource, 1, 200::BIGINT) OVER (PARTITION BY user_id ORDER BY resource) AS nx FROM d)
SELECT user_id, round(sum(q * (ln(1.0 + nx) - ln(1.0 + resource))), 6) AS auc FROM n GROUP BY 1""",
)
def quality_curve_area(spark, sf):
    """Area under each user's right-continuous curve over log(1 + resource) up to a horizon of 200."""
    rows = curve(spark, sf).withColumn("horizon", F.lit(200).cast("bigint"))
    return evaluation.log_auc(rows, ["user_id"], "resource", "value", "pos", "horizon").withColumn("auc", F.round("auc", 6))


@query(
    "quality_at_budgets",
    "WITH " + CURVE_SQL + """, m AS (SELECT user_id, max(resource) + 1 AS b FROM c GROUP BY 1), t AS (SELECT DISTINCT user_id, UNNEST([b // 4, b // 2, b]) AS threshold FROM m)
SELECT t.user_id, CAST(t.threshold AS BIGINT) AS threshold, (SELECT arg_max(c.value, c.pos) FROM c WHERE c.user_id = t.user_id AND c.resource <= t.threshold) AS value FROM t""",
)
def quality_at_budgets(spark, sf):
    """Quality at a quarter, half and all of each user's budget."""
    rows = curve(spark, sf)
    marks = rows.groupBy("user_id").agg((F.max("resource") + 1).alias("b")).select("user_id", evaluation.budget_thresholds("b").alias("thresholds"))
    return evaluation.quality_at(rows, ["user_id"], "resource", "value", "pos", marks)


@query(
    "gain_over_first",
    "WITH " + CURVE_SQL + """, b AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY pos) AS base FROM c)
SELECT user_id, pos, round(CASE WHEN abs(base) <= 1e-12 THEN value - base ELSE (value - base) / abs(base) END, 6) AS baseline_gain,
  round(CASE WHEN abs(400 - base) <= 1e-12 THEN CASE WHEN value >= 400 - 1e-12 THEN 1.0 END ELSE (value - base) / (400 - base) END, 6) AS gap_closed FROM b""",
)
def gain_over_first(spark, sf):
    rows = curve(spark, sf).withColumn("reference", F.lit(400.0))
    found = evaluation.gains(rows, ["user_id"], "pos", "value", "reference")
    return found.select("user_id", "pos", F.round("baseline_gain", 6).alias("baseline_gain"), F.round("gap_closed", 6).alias("gap_closed"))


@query(
    "run_ends",
    "WITH " + CURVE_SQL + " SELECT user_id, min(resource) AS time_to_first_feasible_ms, arg_min(value, pos) AS baseline_quality, arg_max(value, pos) AS final_quality, count(*) AS incumbents FROM c GROUP BY 1",
)
def run_ends(spark, sf):
    return evaluation.run_endpoints(curve(spark, sf), ["user_id"], "pos", "resource", "value")


@query(
    "last_written_cells",
    "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY ALL",
)
def last_written_cells(spark, sf):
    return evaluation.dedupe_cells(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "unfinished_cells",
    """SELECT u.user_id, CAST(b.o AS INT) AS budget_ord, b.t AS budget_id FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (0, 'click'), (1, 'refund'), (2, 'view')) b(o, t)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = b.t AND e.value > 150)""",
)
def unfinished_cells(spark, sf):
    """Planned user x budget cells without a finished row."""
    events = table(spark, sf, "events")
    planned = evaluation.plan_cells(events.select("user_id").distinct(), ["click", "refund", "view"])
    done = events.filter(F.col("value") > 150).select("user_id", F.col("event_type").alias("budget_id"))
    return evaluation.remaining_cells(planned, done, ["user_id", "budget_id"])


@query(
    "journal_gaps",
    "WITH " + JOURNAL_SQL + """, kept AS (SELECT * FROM j WHERE NOT (kind = 'tool_failed' AND value > 300))
SELECT run_id, count(*) AS events, CAST(max(sequence) AS BIGINT) AS last_sequence FROM kept GROUP BY 1 HAVING min(sequence) <> 0 OR max(sequence) + 1 <> count(*)""",
)
def journal_gaps(spark, sf):
    """Journals that lost events."""
    kept = journal_table(spark, sf).filter(~((F.col("kind") == "tool_failed") & (F.col("value") > 300)))
    return readers.event_gaps(kept)


@query(
    "replayed_events",
    "WITH " + JOURNAL_SQL + " SELECT run_id, CAST(sequence AS BIGINT) AS sequence, kind FROM j WHERE run_id = (SELECT min(run_id) FROM j) AND sequence > 10",
)
def replayed_events(spark, sf):
    events = journal_table(spark, sf)
    first = events.agg(F.min("run_id").alias("r"))
    return events.filter((F.col("run_id") == first.scalar()) & (F.col("sequence") > 10)).select("run_id", "sequence", "kind")


CATALOG_SQL = """cat AS (SELECT o_orderkey AS id, CAST(o_totalprice AS BIGINT) AS bytes, CASE WHEN o_orderkey = 0 THEN [] ELSE list_distinct([o_orderkey // 2, o_orderkey // 3]) END AS parents FROM orders)"""


def catalog(spark, sf):
    k = F.col("o_orderkey")
    parents = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3))).cast("array<string>"))
    return table(spark, sf, "orders").select(
        k.cast("string").alias("artifact_id"), F.floor(F.col("o_totalprice")).cast("bigint").alias("byte_size"), parents.alias("parent_ids"),
        F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("L"), (k % 3).cast("string"))).alias("license"),
        F.get(F.array(*map(F.lit, lineage.PRIVACY)), (k % 4).cast("int")).alias("privacy"),
    )


@query(
    "lineage_sizes",
    """WITH RECURSIVE cat AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS bytes, CASE WHEN o_orderkey = 0 THEN [] ELSE [o_orderkey // 2, o_orderkey // 3] END AS parents FROM orders),
links AS (SELECT id, UNNEST(parents) AS parent FROM cat),
walk AS (SELECT o_custkey AS run, max(o_orderkey) AS id FROM orders GROUP BY 1 UNION SELECT w.run, l.parent FROM walk w JOIN links l ON l.id = w.id)
SELECT CAST(run AS VARCHAR) AS run_id, count(*) AS artifact_count, CAST(sum(bytes) AS BIGINT) AS artifact_bytes, max(bytes) AS largest_artifact_bytes FROM walk JOIN cat USING (id) GROUP BY 1""",
)
def lineage_sizes(spark, sf):
    """Artifacts reachable from each customer's last order through two parents per order."""
    seeds = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(F.max("o_orderkey").cast("string").alias("artifact_id"))
    return lineage.lineage_closure(seeds, catalog(spark, sf))


@query(
    "inherited_provenance",
    """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'L' || CAST(o_orderkey % 3 AS VARCHAR) END AS lic, o_orderkey % 4 AS pr FROM orders),
links AS (SELECT DISTINCT o_orderkey AS child, UNNEST([o_orderkey // 2, o_orderkey // 3]) AS parent FROM orders WHERE o_orderkey > 0)
SELECT CAST(l.child AS VARCHAR) AS child_id, ['public', 'internal', 'sensitive', 'restricted'][CAST(max(c.pr) + 1 AS INT)] AS privacy, string_agg(DISTINCT c.lic, ' AND ' ORDER BY c.lic) AS license
FROM links l JOIN c ON c.id = l.parent GROUP BY 1""",
)
def inherited_provenance(spark, sf):
    rows = catalog(spark, sf)
    return lineage.inherit_provenance(rows.select(F.col("artifact_id").alias("child_id"), "parent_ids"), rows)


@query(
    "catalog_audit",
    """SELECT count(*) AS artifact_count, string_agg(DISTINCT source, ',' ORDER BY source) AS source_providers, bool_and(lang = 'en') AS all_public, true AS all_licenses_declared, true AS no_sensitive_metadata_keys FROM documents""",
)
def catalog_audit(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("CC0").alias("license"), F.col("source").alias("source_provider"), F.lit("u").alias("source_uri"), F.lit("1").alias("source_version"),
        F.when(F.col("lang") == "en", "public").otherwise("internal").alias("privacy"), F.to_json(F.struct("lang", "n_chars")).alias("metadata"),
    )
    found = lineage.audit_catalog(docs)
    return found.select(
        "artifact_count", F.array_join("source_providers", ",").alias("source_providers"), "all_public", "all_licenses_declared", "no_sensitive_metadata_keys"
    )


RECORD_SQL = "WITH " + JOURNAL_SQL + ", " + LATENCY_SQL + """, i AS (SELECT run_id, sequence, value, ms, tokens FROM j WHERE kind = 'incumbent_committed'),
e AS (SELECT run_id, arg_min(value, sequence) AS b, arg_max(value, sequence) AS f, count(*) AS n FROM i GROUP BY 1),
l AS (SELECT run_id, sum(latency_ms) AS t FROM lat GROUP BY 1),
d AS (SELECT run_id, tokens, max(value) AS q FROM i WHERE tokens <= 600 GROUP BY ALL),
a AS (SELECT run_id, sum(q * (ln(1.0 + nx) - ln(1.0 + tokens))) AS auc FROM (SELECT *, lead(tokens, 1, 600::BIGINT) OVER (PARTITION BY run_id ORDER BY tokens) AS nx FROM d) GROUP BY 1)
SELECT r.run_id, e.n IS NOT NULL AS feasible, e.b AS baseline_quality, e.f AS final_quality, round((e.f - e.b) / abs(e.b), 6) AS baseline_gain, round(500 - e.f, 6) AS reference_gap, CAST(coalesce(l.t, 0) AS BIGINT) AS tool_latency_ms, round(a.auc, 6) AS auc_tokens
FROM (SELECT DISTINCT run_id FROM j) r LEFT JOIN e USING (run_id) LEFT JOIN l USING (run_id) LEFT JOIN a USING (run_id)"""


@query("run_records", RECORD_SQL)
def run_records(spark, sf):
    """One measured row per run from its journal."""
    events = journal_table(spark, sf)
    runs = events.groupBy("run_id").agg(
        (F.max("relative_monotonic_ms")).alias("wall_horizon"), F.lit(600).cast("bigint").alias("token_horizon"), F.lit(500.0).alias("reference_quality")
    )
    incumbents = events.filter(F.col("kind") == "incumbent_committed").select(
        "run_id", F.col("sequence").alias("position"), F.element_at("artifact_ids", 1).alias("plan_artifact_id"),
        F.col("relative_monotonic_ms").alias("elapsed_ms"), F.col("value").alias("quality"),
    )
    sizes = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("artifact_count"), F.lit(0).alias("artifact_bytes"), F.lit(0).alias("largest_artifact_bytes"))
    found = evaluation.build_run_records(runs, incumbents, events, sizes)
    return found.select(
        "run_id", "feasible", "baseline_quality", "final_quality", F.round("baseline_gain", 6).alias("baseline_gain"),
        F.round("reference_gap", 6).alias("reference_gap"), "tool_latency_ms", F.round("auc_tokens", 6).alias("auc_tokens"),
    )


def _fresh_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # A pattern serves one file and a folder of part files alike.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def _drain(spark, stream, mode="append", keys=()):
    """Run a stream over the files present, into a Parquet folder beside the checkpoints.

    Each batch owns a folder, so that a repeated batch replaces itself; in update mode the last row per key counts.
    """
    root = _fresh_folder(spark)
    journal.use_typed_state(spark)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{root}/data")
    if keys:
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in found.columns if c not in (*keys, "batch")]), "batch").alias("_last")).select(*keys, "_last.*")
    return found.drop("batch")


@query(
    "streamed_budgets",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_used, count(*) FILTER (WHERE event_type = 'click') AS tool_calls_used,
  sum(CAST(json_extract(props, '$.k') AS BIGINT)) > 3000 OR count(*) FILTER (WHERE event_type = 'click') > 15 AS over_limit FROM events GROUP BY 1""",
)
def streamed_budgets(spark, sf):
    """Running token and call budgets per user as a stream."""
    usage = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("run_id"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        (F.col("event_type") == "click").cast("bigint").alias("tool_calls"),
    )
    found = _drain(spark, journal.stream_budget(usage, 3000, 15), "update", ["run_id"])
    return found.select("run_id", "tokens_used", "tool_calls_used", "over_limit")


@query(
    "streamed_unique_actions",
    "SELECT user_id AS run_id, event_type, count(DISTINCT props) AS actions FROM events GROUP BY ALL",
)
def streamed_unique_actions(spark, sf):
    """Actions deduplicated by fingerprint within a run, as a stream."""
    stream = _event_stream(spark, sf).select(F.col("user_id").alias("run_id"), "event_type", F.concat_ws(":", "event_type", "props").alias("fingerprint"))
    return _drain(spark, journal.dedupe_actions(stream)).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("actions"))


@query(
    "streamed_incumbents",
    """WITH s AS (SELECT user_id, event_id, value, event_type, max(value) FILTER (WHERE event_type NOT IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
SELECT CAST(user_id AS VARCHAR) AS problem_hash, event_id AS sequence, CASE WHEN event_type IN ('error', 'view') OR value <= best + 1e-9 THEN 'rejected' ELSE 'committed' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'validation_failed' WHEN event_type = 'view' THEN 'infeasible' WHEN value <= best + 1e-9 THEN 'not_better' END AS reason FROM s""",
)
def streamed_incumbents(spark, sf):
    """Commit or reject each event's value as a candidate of its user, as a stream."""
    stream = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("problem_hash"), F.col("event_id").alias("sequence"), (F.col("event_type") != "error").alias("valid"),
        (F.col("event_type") != "view").alias("feasible"), F.array("value").alias("comparator"),
    )
    return _drain(spark, journal.stream_incumbents(stream))


@query(
    "streamed_redaction",
    """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"auth":{"api_key":"[redacted]","user":' || CAST(user_id AS VARCHAR) || '},"list":[{"Token":"[redacted]"}]}' AS payload FROM events""",
)
def streamed_redaction(spark, sf):
    """Nested sensitive keys masked in flight."""
    secret = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "auth": {"api_key": "x'), F.col("event_id").cast("string"),
        F.lit('", "user": '), F.col("user_id").cast("string"), F.lit('}, "list": [{"Token": {"deep": 1}}]}'),
    )
    stream = _event_stream(spark, sf).select("event_id", secret.alias("payload"))
    return _drain(spark, journal.redact_stream(stream))


@query(
    "streamed_sequence",
    """WITH e AS (SELECT event_id // 40 AS run, event_id % 40 AS q, event_type FROM events WHERE event_id % 97 <> 5 AND event_id % 211 <> 7),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY q) - 1 AS place FROM e)
SELECT CAST(run AS VARCHAR) AS run_id, q AS sequence, event_type AS kind, q = place AS accepted FROM n""",
)
def streamed_sequence(spark, sf):
    """Ordered ingest of runs with missing events: what stands behind a gap is rejected."""
    key = F.col("event_id")
    stream = _event_stream(spark, sf).filter((key % 97 != 5) & (key % 211 != 7)).select(
        F.floor(key / 40).cast("string").alias("run_id"), (key % 40).alias("sequence"), F.col("event_type").alias("kind")
    )
    return _drain(spark, journal.check_sequence(stream))


def _actions(df):
    """Events as action events: a new generation is admitted now and then, late ones name an older generation."""
    key = F.col("event_id")
    kind = F.when(key % 10 == 0, "action_admitted").when(key % 10 == 4, "tool_completed").when(key % 10 == 7, "tool_failed").when(key % 10 == 2, "tool_started").otherwise("note")
    generation = F.floor(key / 10) - F.when((key % 10 != 0) & (key % 7 == 3), 1).otherwise(0)
    return df.select(
        F.floor(key / 200).cast("string").alias("run_id"), F.floor(key / 50).cast("string").alias("action_id"), generation.cast("bigint").alias("action_generation"),
        key.alias("sequence"), kind.alias("kind"), (key * 13 % 1009).alias("relative_monotonic_ms"), F.lit("{}").alias("payload"),
    )


ACTIONS_SQL = """a AS (SELECT CAST(event_id // 200 AS VARCHAR) AS run_id, CAST(event_id // 50 AS VARCHAR) AS action_id, event_id AS sequence,
  event_id // 10 - CASE WHEN event_id % 10 <> 0 AND event_id % 7 = 3 THEN 1 ELSE 0 END AS action_generation, event_id * 13 % 1009 AS ms,
  CASE event_id % 10 WHEN 0 THEN 'action_admitted' WHEN 4 THEN 'tool_completed' WHEN 7 THEN 'tool_failed' WHEN 2 THEN 'tool_started' ELSE 'note' END AS kind FROM events)"""


@query(
    "streamed_live_actions",
    f"""WITH {ACTIONS_SQL},
l AS (SELECT *, max(sequence) FILTER (WHERE kind = 'action_admitted') OVER (PARTITION BY run_id, action_id ORDER BY sequence) AS since FROM a),
g AS (SELECT *, max(CASE WHEN sequence = since THEN action_generation END) OVER (PARTITION BY run_id, action_id, since) AS live FROM l),
k AS (SELECT *, count(*) FILTER (WHERE kind LIKE 'tool_%ed' AND kind <> 'tool_started') OVER (PARTITION BY run_id, action_id, since ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
  FROM g WHERE since IS NOT NULL AND action_generation = live)
SELECT run_id, action_id, action_generation, sequence, kind FROM k WHERE kind = 'action_admitted' OR coalesce(ended, 0) = 0""",
)
def streamed_live_actions(spark, sf):
    """Stale action events dropped in flight."""
    return _drain(spark, journal.drop_stale(_actions(_event_stream(spark, sf))))


@query(
    "streamed_latency",
    f"""WITH {ACTIONS_SQL},
b AS (SELECT *, lag(kind) OVER o AS kind_before, lag(ms) OVER o AS ms_before FROM a WHERE kind IN ('tool_started', 'tool_completed', 'tool_failed')
  WINDOW o AS (PARTITION BY run_id, action_id, action_generation ORDER BY sequence))
SELECT run_id, action_id, action_generation, sequence, 'unknown' AS tool, greatest(ms - ms_before, 0) AS latency_ms FROM b WHERE kind <> 'tool_started' AND kind_before = 'tool_started'""",
)
def streamed_latency(spark, sf):
    """Latency of tool calls as a stream, by the rule of the batch form."""
    return _drain(spark, journal.stream_latency(_actions(_event_stream(spark, sf))))


@query(
    "followed_events",
    """WITH m AS (SELECT (min(event_id) + max(event_id)) // 2 AS mid FROM events)
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS sequence, event_type AS kind, event_id <= mid AS replayed FROM events, m""",
)
def followed_events(spark, sf):
    """The first half of the journal replayed as a batch, the rest followed as a stream from the stored cursor."""
    def journal_rows(df):
        return df.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"))

    whole = table(spark, sf, "events")
    middle = whole.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("mid")).scalar()
    root = _fresh_folder(spark)
    journal_rows(whole.filter(F.col("event_id") <= middle)).write.parquet(f"{root}/replayed")
    replayed = spark.read.parquet(f"{root}/replayed")
    journal.replay_cursor(replayed).write.parquet(f"{root}/cursor")
    followed = _drain(spark, journal.follow(journal_rows(_event_stream(spark, sf)), spark.read.parquet(f"{root}/cursor")))
    return replayed.withColumn("replayed", F.lit(True)).unionByName(followed.withColumn("replayed", F.lit(False)))
