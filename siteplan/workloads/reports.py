"""Benchmark summaries and reports over orders and lines standing for runs and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteplan.operators import evaluation, ordered
from siteplan.workloads import query
from siteplan.workloads.base import table, with_sql

RUN_SQL = """run AS (SELECT o_orderkey AS run_key, o_custkey % 7 AS instance_id, o_orderstatus AS budget_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'deterministic_portfolio' WHEN 1 THEN 'deterministic_baseline' WHEN 2 THEN 'one_shot' ELSE 'iterative' END AS comparison,
  'cpu' || CAST(o_custkey % 3 AS VARCHAR) AS runtime_key, o_orderkey // 4 AS pair_id, o_orderkey % 11 <> 0 AS feasible, o_totalprice / 1000 AS quality,
  greatest(o_custkey % 20 - 15, 0) AS deadline_overshoot_ms, o_custkey % 3 AS tool_failures, o_orderkey % 500 AS tool_calls, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 7 END AS baseline_gain FROM orders)"""


def runs(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "deterministic_portfolio").when(k % 4 == 1, "deterministic_baseline").when(k % 4 == 2, "one_shot").otherwise("iterative")
    return table(spark, sf, "orders").select(
        k.alias("run_key"), (c % 7).alias("instance_id"), F.col("o_orderstatus").alias("budget_id"), kind.alias("comparison"),
        F.concat(F.lit("cpu"), (c % 3).cast("string")).alias("runtime_key"), F.floor(k / 4).alias("pair_id"), (k % 11 != 0).alias("feasible"),
        (F.col("o_totalprice") / 1000).alias("quality"), F.greatest(c % 20 - 15, F.lit(0)).alias("deadline_overshoot_ms"), (c % 3).alias("tool_failures"),
        (k % 500).alias("tool_calls"), F.when(k % 5 != 0, F.col("o_totalprice") / 7).alias("baseline_gain"), F.lit("m").alias("manifest_hash"), F.lit("b").alias("benchmark_id"),
    )


@query(
    "run_summary",
    with_sql(
        RUN_SQL,
        body="""SELECT instance_id, budget_id, comparison, runtime_key, count(*) AS runs, round(avg(feasible::INT), 9) AS feasibility_rate, round(avg(quality) FILTER (WHERE feasible), 6) AS quality_mean,
  round(CASE WHEN count(*) FILTER (WHERE feasible) > 1 THEN var_samp(quality) FILTER (WHERE feasible) END, 4) AS quality_variance,
  round(CASE WHEN count(*) FILTER (WHERE feasible) > 1 THEN 1.96 * sqrt(var_samp(quality) FILTER (WHERE feasible) / count(*) FILTER (WHERE feasible)) END, 6) AS quality_ci95,
  round(avg(baseline_gain) FILTER (WHERE feasible), 6) AS baseline_gain_mean, round(avg(tool_calls), 9) AS tool_calls_mean,
  round(avg((deadline_overshoot_ms > 0)::INT), 9) AS deadline_violation_rate, round(avg((tool_failures > 0)::INT), 9) AS tool_failure_rate FROM run GROUP BY ALL""",
    ),
)
def run_summary(spark, sf):
    found = evaluation.summarize_runs(evaluation.single_manifest(runs(spark, sf)))
    digits = {"feasibility_rate": 9, "quality_mean": 6, "quality_variance": 4, "quality_ci95": 6, "baseline_gain_mean": 6, "tool_calls_mean": 9, "deadline_violation_rate": 9, "tool_failure_rate": 9}
    return found.select(*evaluation.RUN_GROUP, "runs", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(
    "paired_differences",
    with_sql(
        RUN_SQL,
        "d AS (SELECT a.instance_id, a.budget_id, a.runtime_key, a.comparison AS contender, a.quality - b.quality AS d FROM run a JOIN run b ON a.pair_id = b.pair_id AND a.runtime_key = b.runtime_key WHERE a.feasible AND b.feasible AND b.comparison = 'deterministic_portfolio' AND a.comparison IN ('one_shot', 'iterative'))",
        body="SELECT instance_id, budget_id, runtime_key, contender, count(*) AS pairs, round(avg(d), 10) AS delta_mean, round(CASE WHEN count(*) > 1 THEN var_samp(d) END, 4) AS delta_variance FROM d GROUP BY ALL",
    ),
)
def paired_differences(spark, sf):
    found = evaluation.paired_deltas(runs(spark, sf)).drop("delta_ci95")
    return found.withColumns({"delta_mean": F.round("delta_mean", 10), "delta_variance": F.round("delta_variance", 4)})


@query(
    "best_runs",
    with_sql(
        RUN_SQL,
        "r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY quality DESC, -deadline_overshoot_ms DESC, run_key DESC) AS n FROM run WHERE feasible)",
        body="SELECT instance_id, run_key, quality, deadline_overshoot_ms FROM r WHERE n = 1",
    ),
)
def best_runs(spark, sf):
    rows = runs(spark, sf).withColumn("comparator", F.array(F.col("quality"), -F.col("deadline_overshoot_ms").cast("double")))
    return evaluation.best_per_instance(rows).select("instance_id", "run_key", "quality", "deadline_overshoot_ms")


CELL_SQL = """cell AS (SELECT o_orderpriority AS dataset, o_orderstatus AS budget_id, o_orderkey % 3 = 0 AS correct, o_orderkey % 3 <> 1 AS objective_correct, o_orderkey % 5 <> 0 AS agent_plan_found,
  CASE WHEN o_orderkey % 17 = 0 THEN 'x' END AS error, CASE o_orderkey % 4 WHEN 0 THEN 'deadline' WHEN 1 THEN 'done' END AS terminal_reason, o_totalprice / 1000 AS wall, o_custkey AS tin, o_custkey % 100 AS tgen, o_custkey + o_custkey % 100 AS ttot, o_orderkey % 9 AS turns, o_orderkey % 6 AS calls FROM orders),
lev AS (SELECT 'overall' AS level, '*' AS dataset, '*' AS budget, * EXCLUDE (dataset, budget_id) FROM cell UNION ALL SELECT 'dataset', dataset, '*', * EXCLUDE (dataset, budget_id) FROM cell
  UNION ALL SELECT 'budget', '*', budget_id, * EXCLUDE (dataset, budget_id) FROM cell UNION ALL SELECT 'dataset_budget', dataset, budget_id, * EXCLUDE (dataset, budget_id) FROM cell)"""


def cells(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("budget_id"), (k % 3 == 0).alias("correct"), (k % 3 != 1).alias("objective_correct"),
        (k % 5 != 0).alias("agent_plan_found"), F.when(k % 17 == 0, "x").alias("error"), F.when(k % 4 == 0, "deadline").when(k % 4 == 1, "done").alias("terminal_reason"),
        (F.col("o_totalprice") / 1000).alias("wall_time_seconds"), c.alias("input_tokens"), (c % 100).alias("generated_tokens"), (c + c % 100).alias("total_model_tokens"),
        (k % 9).alias("model_generations"), (k % 6).alias("tool_calls"),
    )


@query(
    "grid_report",
    with_sql(
        CELL_SQL,
        "rk AS (SELECT *, row_number() OVER (PARTITION BY level, dataset, budget ORDER BY wall) - 1 AS wi, row_number() OVER (PARTITION BY level, dataset, budget ORDER BY ttot) - 1 AS ti, count(*) OVER (PARTITION BY level, dataset, budget) AS n FROM lev)",
        "re AS (SELECT level, dataset, budget, string_agg(r || '=' || CAST(c AS VARCHAR), ',' ORDER BY r) AS terminal_reasons FROM (SELECT level, dataset, budget, coalesce(terminal_reason, 'unknown') AS r, count(*) AS c FROM lev GROUP BY ALL) GROUP BY ALL)",
        body="""SELECT level, dataset, budget, count(*) AS cells, round(avg(correct::INT), 9) AS accuracy, round(avg(objective_correct::INT), 9) AS objective_accuracy, round(avg(agent_plan_found::INT), 9) AS agent_plan_rate, round(avg((error IS NOT NULL)::INT), 9) AS error_rate,
  CAST(sum(tin) AS BIGINT) AS total_input, CAST(sum(tgen) AS BIGINT) AS total_generated, round(min(wall) FILTER (WHERE wi = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)), 3) AS wall_p50, round(min(wall) FILTER (WHERE wi = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)), 3) AS wall_p95,
  CAST(min(ttot) FILTER (WHERE ti = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS DOUBLE) AS p95_total, any_value(terminal_reasons) AS terminal_reasons FROM rk JOIN re USING (level, dataset, budget) GROUP BY level, dataset, budget""",
    ),
)
def grid_report(spark, sf):
    """Overall, per dataset, per budget and per both."""
    found = evaluation.grid_report(cells(spark, sf))
    pairs = F.transform(F.map_entries("terminal_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    rates = ("accuracy", "objective_accuracy", "agent_plan_rate", "error_rate")
    return found.select(
        *evaluation.LEVEL, "cells", *[F.round(c, 9).alias(c) for c in rates], "total_input", "total_generated", "wall_p50", "wall_p95", "p95_total",
        F.array_join(pairs, ",").alias("terminal_reasons"),
    )


@query(
    "experiment_summary",
    with_sql(
        CELL_SQL,
        body="""SELECT level, dataset, budget, count(*) AS cells, count(*) FILTER (WHERE correct) AS correct, round(avg(correct::INT), 9) AS accuracy, count(error) AS errors, round(avg(ttot), 6) AS mean_total_model_tokens,
  CASE WHEN level = 'overall' THEN greatest((SELECT count(*) FROM customer) * 20 - count(*), 0) END AS remaining_cells FROM lev WHERE level <> 'dataset_budget' GROUP BY level, dataset, budget""",
    ),
)
def experiment_summary(spark, sf):
    planned = table(spark, sf, "customer").agg((F.count(F.lit(1)) * 20).alias("n")).scalar()
    found = evaluation.experiment_summary(cells(spark, sf), planned)
    return found.select(
        *evaluation.LEVEL, "cells", "correct", F.round("accuracy", 9).alias("accuracy"), "errors", F.round("mean_total_model_tokens", 6).alias("mean_total_model_tokens"), "remaining_cells"
    )


@query(
    "metric_means",
    """WITH m AS (SELECT l_returnflag AS k, l_shipmode AS n, v FROM (SELECT l_returnflag, UNNEST(['quantity', 'price', 'tax']) AS l_shipmode, UNNEST([l_quantity, l_extendedprice, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END]) AS v FROM lineitem) WHERE v IS NOT NULL)
SELECT k AS l_returnflag, string_agg(n || '=' || CAST(CAST(round(a, 2) * 100 AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS means FROM (SELECT k, n, avg(v) AS a FROM m GROUP BY ALL) GROUP BY 1""",
)
def metric_means(spark, sf):
    """Mean per metric name over the rows that have the metric."""
    metrics = F.map_from_arrays(F.array(*map(F.lit, ("quantity", "price", "tax"))), F.array("l_quantity", "l_extendedprice", "l_tax"))
    trimmed = F.when(F.col("l_linenumber") == 1, F.map_filter(metrics, lambda k, v: k != "tax")).otherwise(metrics)
    rows = table(spark, sf, "lineitem").select("l_returnflag", trimmed.alias("metrics"))
    means = evaluation.mean_of_maps(rows, ["l_returnflag"], "metrics", "means")
    text = F.transform(F.map_entries("means"), lambda e: F.concat_ws("=", e["key"], (F.round(e["value"], 2) * 100).cast("bigint").cast("string")))
    return means.select("l_returnflag", F.array_join(text, ",").alias("means"))


@query(
    "nested_metric_means",
    """WITH a AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_returnflag, string_agg(l_linestatus || ':' || CAST(CAST(round(q, 3) * 1000 AS BIGINT) AS VARCHAR), ',' ORDER BY l_linestatus) AS means FROM a GROUP BY 1""",
)
def nested_metric_means(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.create_map(F.col("l_linestatus"), F.create_map(F.lit("quantity"), F.col("l_quantity"))).alias("groups")
    )
    found = evaluation.mean_of_nested_maps(rows, ["l_returnflag"], "groups", "means")
    value = lambda e: (F.round(F.get_json_object(e["value"], "$.quantity").cast("double"), 3) * 1000).cast("bigint").cast("string")
    text = F.transform(F.map_entries("means"), lambda e: F.concat_ws(":", e["key"], value(e)))
    return found.select("l_returnflag", F.array_join(text, ",").alias("means"))


@query(
    "flattened_metrics",
    """SELECT l_returnflag, l_linestatus, 'price' AS metric, round(sum(l_extendedprice), 4) AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, l_linestatus, 'quantity', round(sum(l_quantity), 4) FROM lineitem GROUP BY ALL""",
)
def flattened_metrics(spark, sf):
    """Metric maps to long form and back."""
    keys = ["l_returnflag", "l_linestatus"]
    wide = table(spark, sf, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    wide = wide.select(*keys, F.create_map(F.lit("quantity"), F.col("q"), F.lit("price"), F.col("p")).alias("metrics"))
    long = evaluation.metrics_long(wide, keys, "metrics")
    again = evaluation.metrics_long(evaluation.metrics_wide(long, keys, "metrics"), keys, "metrics")
    return again.withColumn("value", F.round("value", 4))


@query(
    "label_quality",
    """SELECT lang, source, count(*) AS docs, round(avg(quality), 9) AS quality_mean, round(CASE WHEN count(*) > 1 THEN var_samp(quality) END, 9) AS quality_variance, round(CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(quality) / count(*)) END, 9) AS quality_ci95
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)
def label_quality(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    found = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), *evaluation.describe_ci("quality", "quality"))
    return found.select("lang", "source", "docs", *[F.round(c, 9).alias(c) for c in ("quality_mean", "quality_variance", "quality_ci95")])


JOB_SQL = """job AS (SELECT o_orderkey AS job_id, o_orderdate AS c, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL 1 HOUR * (o_custkey % 5 - 1) END AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0.5 + o_custkey % 3 END AS rate, o_orderkey % 7 <> 0 AS has FROM orders)"""


def _jobs(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.col("o_orderdate").cast("timestamp")
    jobs = table(spark, sf, "orders").select(
        k.alias("job_id"), stamp(start).alias("created_at"), F.lit(None).cast("string").alias("launched_at"),
        F.when(k % 6 != 0, F.date_format(F.timestamp_seconds(F.unix_seconds(start) + (c % 5 - 1) * 3600), "yyyy-MM-dd'T'HH:mm:ss")).alias("stopped_at"),
        F.lit(None).cast("string").alias("terminated_at"), F.when(k % 10 != 0, (c % 3).cast("double") + 0.5).alias("cost_per_hour"),
    )
    none = F.lit(None).cast("string")
    statuses = table(spark, sf, "orders").filter(k % 7 != 0).select(
        k.alias("job_id"), F.lit("done").alias("status"), none.alias("container_started_at"), none.alias("started_at"), none.alias("finished_at")
    )
    return jobs, statuses


@query(
    "job_costs",
    with_sql(
        JOB_SQL,
        body="""SELECT job_id, CASE WHEN has THEN 'done' ELSE 'missing_artifacts' END AS status, CAST(CASE WHEN s IS NOT NULL THEN greatest(epoch(s) - epoch(c), 0) END AS DOUBLE) AS billed_seconds,
  round(CASE WHEN s IS NOT NULL THEN greatest(epoch(s) - epoch(c), 0) END * rate / 3600, 6) AS estimated_cost_usd, s IS NOT NULL AS stopped FROM job""",
    ),
)
def job_costs(spark, sf):
    """Billed time and cost per job; negative spans count as 0."""
    report = evaluation.cost_report(*_jobs(spark, sf))
    return report.select("job_id", "status", "billed_seconds", "estimated_cost_usd", "stopped")


@query(
    "job_cost_totals",
    with_sql(
        JOB_SQL,
        body="SELECT count(*) AS job_count, count(*) FILTER (WHERE has) AS jobs_with_artifacts, round(sum(CASE WHEN s IS NOT NULL THEN greatest(epoch(s) - epoch(c), 0) END * rate / 3600), 6) AS estimated_cost_usd, bool_and(s IS NOT NULL) AS complete FROM job",
    ),
)
def job_cost_totals(spark, sf):
    return evaluation.cost_totals(evaluation.cost_report(*_jobs(spark, sf)))


@query(
    "release_maxima",
    with_sql(RUN_SQL, body="SELECT count(*) AS run_count, max(deadline_overshoot_ms) AS deadline_overshoot_ms, max(tool_calls) AS artifact_count FROM run"),
)
def release_maxima(spark, sf):
    rows = runs(spark, sf).withColumn("artifact_count", F.col("tool_calls"))
    return evaluation.release_profile(rows, 10_000).select("run_count", "deadline_overshoot_ms", "artifact_count")


@query(
    "ranked_candidates",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_orderkey) > 1 AS ambiguous FROM lineitem)
SELECT * FROM r WHERE rank <= 3""",
)
def ranked_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("_down", -F.col("l_extendedprice"))
    found = evaluation.rank_candidates(rows, "l_orderkey", ["_down", "l_partkey", "l_suppkey", "l_linenumber"], 3)
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "rank", "ambiguous")


@query("price_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def price_positions(spark, sf):
    """Rank of every order by price over the whole table, without a single-task window."""
    return ordered.positions(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"]).drop("o_totalprice")
