"""Quality curves, run journals, run records, summaries and reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.operators.ordered import following, group_quantiles, positions, quantile_ceil, running
from siteplan.session import cut_lineage

# Event kinds that end a tool call, commit a plan, or come from the model.
TOOL_ENDS = ("tool_completed", "tool_cancelled", "tool_failed")
COMMITS = ("baseline_committed", "incumbent_committed")
MODEL_EVENTS = ("model_action_proposed", "action_rejected")
TINY = 1e-12
Z95 = 1.96


def _finite(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != math.inf), column)


def describe_ci(column: Column | str, prefix: str) -> list[Column]:
    """Mean, sample variance (null for one value) and 95% half-width over the finite values."""
    value = _finite((F.col(column) if isinstance(column, str) else column).cast("double"))
    count, variance = F.count(value), F.var_samp(value)
    spread = F.when(count > 1, variance)
    return [
        F.avg(value).alias(f"{prefix}_mean"),
        spread.alias(f"{prefix}_variance"),
        (F.sqrt(spread / count) * Z95).alias(f"{prefix}_ci95"),
    ]


def log_auc(curve: DataFrame, keys: Sequence[str], resource: str, quality: str, order: str, horizon: str, name: str = "auc") -> DataFrame:
    """Area under the right-continuous quality curve over log(1 + resource), per key.

    The last quality at a resource counts and is carried to the next resource or to the horizon
    column; nothing is added before the first point. A resource that goes back, is negative or lies
    beyond the horizon raises.
    """
    seen = running(curve, keys, [order], {"_high": ("max", F.col(resource))}, inclusive=False)
    bad = F.raise_error(F.lit("curve must be ordered, non-negative and within its horizon")).cast("double")
    sound = (F.col(resource) >= 0) & (F.col(resource) <= F.col(horizon))
    sound = sound & (F.col("_high").isNull() | (F.col(resource) >= F.col("_high"))) & ~F.isnan(F.col(quality))
    checked = seen.withColumn(quality, F.when(sound, F.col(quality).cast("double")).otherwise(bad))
    points = checked.groupBy(*keys, resource).agg(F.max_by(quality, order).alias(quality), F.max(horizon).alias(horizon))
    led = following(points, keys, [resource], {"_next": F.col(resource)})
    stop = F.coalesce("_next", horizon)
    area = F.col(quality) * (F.log1p(stop) - F.log1p(resource))
    return led.groupBy(*keys).agg(F.sum(area).alias(name))


def quality_at(curve: DataFrame, keys: Sequence[str], resource: str, quality: str, order: str, thresholds: DataFrame) -> DataFrame:
    """Last quality at or before each threshold (null before the first point).

    ``thresholds`` holds the keys and a short ``thresholds`` array per key.
    """
    rows = curve.join(thresholds, list(keys)).withColumn("threshold", F.explode("thresholds"))
    at = F.when(F.col(resource) <= F.col("threshold"), F.struct(resource, order))
    found = rows.groupBy(*keys, "threshold").agg(F.max_by(quality, at).alias(quality))
    # Keys without any point still report their thresholds.
    wanted = thresholds.select(*keys, F.explode("thresholds").alias("threshold"))
    return wanted.join(found, [*keys, "threshold"], "left")


def budget_thresholds(column: Column | str) -> Column:
    """Quarter, half and full budget in whole units, each once, ascending."""
    b = (F.col(column) if isinstance(column, str) else column).cast("bigint")
    return F.array_sort(F.array_distinct(F.array(F.floor(b / 4), F.floor(b / 2), b)))


def relative_gain(current: Column, baseline: Column) -> Column:
    size = F.abs(baseline)
    return F.when(size <= TINY, current - baseline).otherwise((current - baseline) / size)


def gap_closed(current: Column, baseline: Column, reference: Column) -> Column:
    """Share of the gap to the reference closed; with no gap 1 when reached, else null."""
    gap = reference - baseline
    reached = F.when(current >= reference - TINY, 1.0)
    return F.when(F.abs(gap) <= TINY, reached).otherwise((current - baseline) / gap)


def gains(timeline: DataFrame, keys: Sequence[str], order: str, quality: str, reference: str | None = None) -> DataFrame:
    """Gain over the first incumbent of each key and, with a reference column, the gap closed."""
    rows = running(timeline, keys, [order], {"_base": ("first", F.col(quality))})
    rows = rows.withColumn("baseline_gain", relative_gain(F.col(quality), F.col("_base")))
    if reference:
        rows = rows.withColumn("gap_closed", gap_closed(F.col(quality), F.col("_base"), F.col(reference)))
    return rows.drop("_base")


def run_endpoints(timeline: DataFrame, keys: Sequence[str], order: str, elapsed: str, quality: str) -> DataFrame:
    """First feasible time, baseline and final quality per run."""
    return timeline.groupBy(*keys).agg(
        F.min_by(elapsed, order).alias("time_to_first_feasible_ms"),
        F.min_by(quality, order).alias("baseline_quality"),
        F.max_by(quality, order).alias("final_quality"),
        F.count(F.lit(1)).alias("incumbents"),
    )


def dedupe_cells(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last written row per cell, by a plain aggregate (no sort of a cell's rows)."""
    last = F.max_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last.alias("_r")).select("_r.*")


def tool_latency(events: DataFrame) -> DataFrame:
    """Finished tool calls: ``run_id, action_id, action_generation, tool, latency_ms``.

    A terminal event ends the latest start of its action generation, once.
    """
    calls = events.filter(
        F.col("action_id").isNotNull() & F.col("action_generation").isNotNull() & F.col("kind").isin("tool_started", *TOOL_ENDS)
    )
    keys = ["run_id", "action_id", "action_generation"]
    begun = F.when(F.col("kind") == "tool_started", F.col("relative_monotonic_ms"))
    tool = F.coalesce(F.get_json_object("payload", "$.tool"), F.lit("unknown"))
    before = F.struct(begun.alias("ms"), tool.alias("tool"))
    paired = running(calls, keys, ["sequence"], {"_before": ("last", before)}, inclusive=False)
    ended = paired.filter(F.col("kind").isin(*TOOL_ENDS) & F.col("_before.ms").isNotNull())
    spent = F.greatest(F.col("relative_monotonic_ms") - F.col("_before.ms"), F.lit(0))
    return ended.select(*keys, "sequence", F.col("_before.tool").alias("tool"), spent.alias("latency_ms"))


def event_profile(events: DataFrame) -> DataFrame:
    """Counts and last budget per run. ``budget_before``/``budget_after`` are JSON text."""
    kind, reason = F.col("kind"), F.get_json_object("payload", "$.reason")
    used = lambda column, field: F.get_json_object(column, f"$.{field}").cast("bigint")
    by_model = (F.col("actor") == "model") & kind.isin(*MODEL_EVENTS)
    spent = lambda field: F.greatest(used("budget_after", field) - used("budget_before", field), F.lit(0))
    return events.groupBy("run_id").agg(
        F.count_if(kind == "candidate_rejected").alias("rejected_candidates"),
        F.count_if((kind == "candidate_rejected") & (reason == "validation_failed")).alias("invalid_candidates"),
        F.count_if((kind == "action_rejected") & (reason == "model_failure")).alias("model_failures"),
        F.count_if((kind == "action_rejected") & (reason == "malformed_action")).alias("repairs"),
        F.count_if(kind == "tool_failed").alias("tool_failures"),
        F.coalesce(F.max_by(used("budget_after", "tool_calls"), "sequence"), F.lit(0)).alias("tool_calls"),
        F.coalesce(F.sum(F.when(by_model, spent("input_tokens"))), F.lit(0)).alias("model_input_tokens"),
        F.coalesce(F.sum(F.when(by_model, spent("generated_tokens"))), F.lit(0)).alias("model_generated_tokens"),
        F.max(F.when(by_model, spent("input_tokens"))).alias("max_action_input_tokens"),
        F.max(F.when(by_model, spent("generated_tokens"))).alias("max_action_generated_tokens"),
        F.max(F.when(by_model, F.get_json_object("payload", "$.compact_context_bytes").cast("bigint"))).alias("max_context_bytes"),
    )


def checkpoints(incumbents: DataFrame, events: DataFrame) -> DataFrame:
    """Incumbents (run_id, position, plan_artifact_id, ...) with tokens and tool calls spent at their commit.

    An incumbent without a commit event carries the last known budget forward, 0 at first.
    """
    commits = events.filter(F.col("kind").isin(*COMMITS)).select(
        "run_id", "sequence", "budget_after", F.explode("artifact_ids").alias("plan_artifact_id")
    )
    last = commits.groupBy("run_id", "plan_artifact_id").agg(F.max_by("budget_after", "sequence").alias("_budget"))
    joined = incumbents.join(last, ["run_id", "plan_artifact_id"], "left")
    field = lambda name: F.get_json_object("_budget", f"$.{name}").cast("bigint")
    carried = running(
        joined, ["run_id"], ["position"],
        {"total_model_tokens": ("last", field("total_tokens")), "tool_calls": ("last", field("tool_calls"))},
    )
    return carried.drop("_budget").fillna(0, ["total_model_tokens", "tool_calls"])


def build_run_records(runs: DataFrame, incumbents: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One measured row per run.

    ``runs``: run_id, wall_horizon, token_horizon, reference_quality and descriptive columns.
    ``incumbents``: run_id, position, plan_artifact_id, elapsed_ms, quality.
    ``artifacts``: run_id, artifact_count, artifact_bytes, largest_artifact_bytes (see the closure operator).
    """
    # The checkpoints feed seven aggregates; they are few beside the events, so they are kept once.
    points = cut_lineage(checkpoints(incumbents, events))
    ends = run_endpoints(points, ["run_id"], "position", "elapsed_ms", "quality")
    spent = tool_latency(events).groupBy("run_id").agg(F.sum("latency_ms").alias("tool_latency_ms"))
    horizons = runs.select("run_id", "wall_horizon", "token_horizon")

    def curve(resource: str, horizon: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = points.join(horizons, "run_id")
        area = log_auc(rows.filter(F.col(resource) <= F.col(horizon)), ["run_id"], resource, "quality", "position", horizon, f"auc_{name}")
        marks = horizons.select("run_id", budget_thresholds(horizon).alias("thresholds"))
        sampled = quality_at(points, ["run_id"], resource, "quality", "position", marks)
        entries = F.sort_array(F.collect_list(F.struct("threshold", "quality")))
        return area, sampled.groupBy("run_id").agg(entries.alias(f"quality_at_{name}"))

    time_area, time_marks = curve("elapsed_ms", "wall_horizon", "time")
    token_area, token_marks = curve("total_model_tokens", "token_horizon", "tokens")
    rows = runs
    for part in (ends, event_profile(events), spent, artifacts, time_area, time_marks, token_area, token_marks):
        rows = rows.join(part, "run_id", "left")
    gain = relative_gain(F.col("final_quality"), F.col("baseline_quality"))
    closed = gap_closed(F.col("final_quality"), F.col("baseline_quality"), F.col("reference_quality"))
    return rows.withColumns(
        {
            "feasible": F.col("final_quality").isNotNull(),
            "baseline_gain": gain,
            "gap_closed": closed,
            "reference_gap": F.col("reference_quality") - F.col("final_quality"),
        }
    ).fillna(0, ["tool_latency_ms"])


def mean_of_maps(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Mean per metric name over the rows that have it, as a map in name order."""
    entries = df.select(*keys, F.explode(column).alias("metric", "value"))
    means = entries.groupBy(*keys, "metric").agg(F.avg(_finite(F.col("value"))).alias("mean")).filter("mean is not null")
    return means.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "mean")))).alias(name))


def mean_of_nested_maps(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The same for a map of maps (group or scenario to metric)."""
    outer = df.select(*keys, F.explode(column).alias("outer", "inner"))
    inner = mean_of_maps(outer, [*keys, "outer"], "inner", "means")
    return inner.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outer", F.to_json("means").alias("means"))))).alias(name))


def metrics_long(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.select(*keys, F.explode(column).alias("metric", "value"))


def metrics_wide(long: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return long.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


RUN_GROUP = ("instance_id", "budget_id", "comparison", "runtime_key")
RUN_MEANS = (
    "deadline_overshoot_ms", "input_tokens", "generated_tokens", "reasoning_tokens", "total_model_tokens", "tool_calls", "tool_latency_ms",
)
FEASIBLE_MEANS = ("baseline_gain", "reference_gap", "time_to_first_feasible_ms", "auc_time", "auc_tokens")


def single_manifest(runs: DataFrame) -> DataFrame:
    """The runs, raising when they mix benchmark manifests."""
    counts = runs.agg(F.count_distinct("manifest_hash", "benchmark_id").alias("n"))
    mixed = F.raise_error(F.lit("summaries cannot mix benchmark manifests")).cast("boolean")
    return runs.withColumn("_n", counts.scalar()).filter(F.when(F.col("_n") > 1, mixed).otherwise(True)).drop("_n")


def summarize_runs(runs: DataFrame, keys: Sequence[str] = RUN_GROUP) -> DataFrame:
    """Benchmark summary per group; quality figures over feasible rows only."""
    feasible = F.col("feasible")
    present = [c for c in FEASIBLE_MEANS if c in runs.columns]
    means = [c for c in RUN_MEANS if c in runs.columns]
    rates = {
        "deadline_violation_rate": "deadline_overshoot_ms", "tool_failure_rate": "tool_failures",
        "model_failure_rate": "model_failures", "parse_repair_rate": "repairs",
    }
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(feasible.cast("double")).alias("feasibility_rate"),
        *describe_ci(F.when(feasible, F.col("quality")), "quality"),
        *[F.avg(F.when(feasible, _finite(F.col(c).cast("double")))).alias(f"{c}_mean") for c in present],
        *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_mean") for c in means],
        *[F.avg((F.col(c) > 0).cast("double")).alias(r) for r, c in rates.items() if c in runs.columns],
    )


def paired_deltas(runs: DataFrame, baseline: str = "deterministic_portfolio", excluded: Sequence[str] = ("deterministic_baseline",)) -> DataFrame:
    """Quality difference of each contender to the feasible portfolio run of its pair and runtime."""
    good = runs.filter("feasible")
    base = good.filter(F.col("comparison") == baseline).select("pair_id", "runtime_key", F.col("quality").alias("_base"))
    others = good.filter(~F.col("comparison").isin(baseline, *excluded))
    delta = others.join(base, ["pair_id", "runtime_key"]).withColumn("delta", F.col("quality") - F.col("_base"))
    grouped = delta.groupBy("instance_id", "budget_id", "runtime_key", F.col("comparison").alias("contender"))
    return grouped.agg(F.count(F.lit(1)).alias("pairs"), *describe_ci("delta", "delta"))


LEVEL = ("level", "dataset", "budget")


def _levels(rows: DataFrame) -> DataFrame:
    """Each row under its four report groups; ``*`` stands for all."""
    d, b, star = F.col("dataset").cast("string"), F.col("budget_id").cast("string"), F.lit("*")
    group = lambda level, x, y: F.struct(F.lit(level).alias("level"), x.alias("dataset"), y.alias("budget"))
    groups = F.array(group("overall", star, star), group("dataset", d, star), group("budget", star, b), group("dataset_budget", d, b))
    return rows.withColumn("_g", F.explode(groups)).drop("dataset").select("*", "_g.*").drop("_g")


def grid_report(rows: DataFrame) -> DataFrame:
    """Overall, per dataset, per budget and per both: rates, reasons, time and token figures.

    Rows hold dataset, budget_id, correct, objective_correct, agent_plan_found, error,
    terminal_reason, wall_time_seconds, input_tokens, generated_tokens, total_model_tokens,
    model_generations, tool_calls; missing figures count as 0.
    """
    numbers = ("wall_time_seconds", "input_tokens", "generated_tokens", "total_model_tokens", "model_generations", "tool_calls")
    # Cells of one dataset and budget are added up before they are copied to their four groups.
    each, given = ["dataset", "budget_id"], rows.fillna(0, list(numbers))
    hits = {
        "accuracy": F.coalesce("correct", F.lit(False)), "objective_accuracy": F.coalesce("objective_correct", F.lit(False)),
        "agent_plan_rate": F.coalesce("agent_plan_found", F.lit(False)), "error_rate": F.col("error").isNotNull(),
    }
    cells = _levels(given.groupBy(*each).agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(c).alias(f"_{n}") for n, c in hits.items()],
        *[F.sum(c).alias(c) for c in numbers],
    ))
    total = F.sum("cells")
    mean = lambda c, digits: F.round(F.sum(c) / total, digits)
    base = cells.groupBy(*LEVEL).agg(
        total.alias("cells"), *[(F.sum(f"_{n}") / total).alias(n) for n in hits],
        mean("wall_time_seconds", 3).alias("wall_mean"), mean("input_tokens", 1).alias("mean_input"),
        mean("generated_tokens", 1).alias("mean_generated"), mean("total_model_tokens", 1).alias("mean_total"),
        F.sum("input_tokens").alias("total_input"), F.sum("generated_tokens").alias("total_generated"),
        mean("model_generations", 2).alias("mean_model_turns"), mean("tool_calls", 2).alias("mean_tool_calls"),
    )
    reason = F.coalesce("terminal_reason", F.lit("unknown")).alias("r")
    reasons = _levels(given.groupBy(*each, reason).agg(F.count(F.lit(1)).alias("n"))).groupBy(*LEVEL, "r").agg(F.sum("n").alias("n"))
    packed = reasons.groupBy(*LEVEL).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("r", "n")))).alias("terminal_reasons"))
    report = base.join(packed, list(LEVEL))
    for value, quantiles, digits in (("wall_time_seconds", {"wall_p50": 0.5, "wall_p95": 0.95}, 3), ("total_model_tokens", {"p95_total": 0.95}, 1)):
        figures = group_quantiles(given, each, value, quantiles, _levels, LEVEL)
        report = report.join(figures.select(*LEVEL, *[F.round(F.col(n).cast("double"), digits).alias(n) for n in quantiles]), list(LEVEL))
    return report


def experiment_summary(rows: DataFrame, planned: Column | int) -> DataFrame:
    """Accuracy, errors and mean figures per dataset, per budget and overall, with planned and remaining cells."""
    cells = _levels(rows).filter(F.col("level") != "dataset_budget")
    total = planned if isinstance(planned, Column) else F.lit(planned)
    summary = cells.groupBy(*LEVEL).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("correct").alias("correct"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.coalesce("objective_correct", "correct").cast("double")).alias("objective_accuracy"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.avg("total_model_tokens").alias("mean_total_model_tokens"),
        F.avg("wall_time_seconds").alias("mean_budget_elapsed_seconds"),
    )
    remaining = F.when(F.col("level") == "overall", F.greatest(total - F.col("cells"), F.lit(0)))
    return summary.withColumn("remaining_cells", remaining)


def remaining_cells(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned cells without a finished row."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def plan_cells(records: DataFrame, budgets: Sequence[str]) -> DataFrame:
    """Every record under every budget of a short list, in budget order per record."""
    listed = F.posexplode(F.array(*map(F.lit, budgets))).alias("budget_ord", "budget_id")
    return records.select("*", listed)


def latency_profile(observations: DataFrame, declared: DataFrame) -> DataFrame:
    """Measured p50/p95 per tool against its declared estimates (tools with both only).

    ``observations``: tool, latency_ms; ``declared``: tool, declared_p50_ms, declared_p95_ms.
    """
    counts = observations.groupBy("tool").agg(F.count("latency_ms").alias("observations"))
    half = quantile_ceil(observations, ["tool"], "latency_ms", 0.5, "measured_p50_ms")
    most = quantile_ceil(observations, ["tool"], "latency_ms", 0.95, "measured_p95_ms")
    joined = counts.join(half, "tool").join(most, "tool").join(declared, "tool")
    return joined.withColumn("within_declared_p95", F.col("measured_p95_ms") <= F.col("declared_p95_ms"))


def release_profile(records: DataFrame, context_limit: int) -> DataFrame:
    """Maxima over all runs, one row."""
    names = (
        "max_action_input_tokens", "max_action_generated_tokens", "max_context_bytes", "artifact_count",
        "artifact_bytes", "largest_artifact_bytes", "deadline_overshoot_ms",
    )
    present = [n for n in names if n in records.columns]
    maxima = records.agg(F.count(F.lit(1)).alias("run_count"), *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in present])
    return maxima.withColumn("context_within_limit", F.col("max_context_bytes") <= context_limit) if "max_context_bytes" in present else maxima


def best_per_instance(runs: DataFrame) -> DataFrame:
    """The feasible run with the largest comparator per instance (array order is lexicographic)."""
    best = runs.filter("feasible").groupBy("instance_id").agg(F.max_by(F.struct(*runs.columns), F.struct("comparator", "run_key")).alias("_b"))
    return best.select("_b.*")


def rank_candidates(df: DataFrame, query: str, order: Sequence[str], limit: int) -> DataFrame:
    """Rank per query, ambiguity flag when a query has more than one candidate, first ``limit`` kept."""
    ranked = positions(df, [query], order, name="rank", total="_n")
    return ranked.withColumn("ambiguous", F.col("_n") > 1).filter(F.col("rank") <= limit).drop("_n")


def cost_report(jobs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Elapsed stretches and estimated cost per job. Naive timestamps count as UTC; negative spans as 0.

    ``jobs``: job_id, created_at, launched_at, stopped_at, terminated_at, cost_per_hour (text times);
    ``statuses``: job_id, status, container_started_at, started_at, finished_at.
    """
    joined = jobs.join(statuses.withColumn("artifacts_found", F.lit(True)), "job_id", "left")
    moment = lambda *names: F.coalesce(*[F.try_to_timestamp(F.col(n)) for n in names])
    stamped = joined.withColumns(
        {
            "_created": moment("created_at", "launched_at"), "_container": moment("container_started_at", "started_at"),
            "_work": moment("started_at"), "_finished": moment("finished_at"), "_stopped": moment("stopped_at", "terminated_at"),
        }
    )
    span = lambda a, b: F.greatest((F.unix_micros(b) - F.unix_micros(a)) / 1e6, F.lit(0.0))
    seconds = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), span(F.col(a), F.col(b)))
    return stamped.select(
        "job_id", F.coalesce("status", F.lit("missing_artifacts")).alias("status"),
        seconds("_created", "_container").alias("start_seconds"), seconds("_container", "_work").alias("setup_seconds"),
        seconds("_finished", "_stopped").alias("completion_to_stop_seconds"), seconds("_created", "_stopped").alias("billed_seconds"),
        F.round(seconds("_created", "_stopped") * F.col("cost_per_hour") / 3600, 6).alias("estimated_cost_usd"),
        F.col("_stopped").isNotNull().alias("stopped"), F.coalesce("artifacts_found", F.lit(False)).alias("artifacts_found"),
    )


def cost_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("job_count"), F.count_if("artifacts_found").alias("jobs_with_artifacts"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("estimated_cost_usd"), F.every("stopped").alias("complete"),
    )


def estimate_cost(features: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Linear estimate base + sum(weight x feature) per item; a missing feature is 0, a negative one raises.

    ``features``: key, feature, value. ``model``: feature, weight, with one row ``base``.
    """
    bad = F.raise_error(F.lit("features cannot be negative")).cast("double")
    value = F.when(F.col("value") < 0, bad).otherwise(F.col("value"))
    joined = features.join(model.filter(F.col("feature") != "base"), "feature", "left")
    base = model.filter(F.col("feature") == "base").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("b"))
    summed = joined.groupBy(key).agg(F.coalesce(F.sum(value * F.coalesce("weight", F.lit(0.0))), F.lit(0.0)).alias("_s"))
    return summed.withColumn("estimate", F.col("_s") + base.scalar()).drop("_s")
