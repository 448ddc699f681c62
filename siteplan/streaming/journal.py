"""Structured Streaming over run journals: ordered ingest, deduplication, incumbents, budgets, latency."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteplan.functions.text import redact_json
from siteplan.operators.evaluation import TOOL_ENDS
from siteplan.plans.scoring import TOLERANCE
from siteplan.sources.readers import RUN_EVENT_SCHEMA

ADMITTED = ("action_admitted",)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None, file_format: str = "json") -> DataFrame:
    """Journal files of a folder as a stream."""
    reader = spark.readStream.schema(RUN_EVENT_SCHEMA).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def replay(events: DataFrame, run_id: str, after: int) -> DataFrame:
    """Events of a run behind a cursor; the same filter serves a batch replay and a following stream."""
    return events.filter((F.col("run_id") == run_id) & (F.col("sequence") > after))


def replay_cursor(replayed: DataFrame) -> DataFrame:
    """``run_id, cursor``: the last sequence of each run in a replayed part of a journal, to be stored with it."""
    return replayed.groupBy("run_id").agg(F.max("sequence").alias("cursor"))


def follow(events: DataFrame, cursor: DataFrame) -> DataFrame:
    """The events of a stream behind a stored cursor, all events of runs that it does not know.

    The stream may start at the beginning of the journal: what the replay had is left out by its sequence, so replay and
    stream together give each event once. A run's sequences must be written in order, as ``check_sequence`` ensures.
    """
    stored = cursor.select(F.col("run_id").alias("_run"), "cursor")
    joined = events.join(stored, F.col("run_id") == F.col("_run"), "left")
    return joined.filter(F.col("cursor").isNull() | (F.col("sequence") > F.col("cursor"))).drop("_run", "cursor")


def use_typed_state(spark: SparkSession) -> None:
    """Streams with typed state need the RocksDB state store; keep another choice that the session has made."""
    if spark.conf.get(STATE_STORE, None) in (None, DEFAULT_STORE):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sequence(StatefulProcessor):
    """The expected sequence of a run, and the rows that came before their turn."""

    def __init__(self, hold: bool):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "sequence BIGINT")
        self.early = handle.getMapState("early", "sequence BIGINT", "kind STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call on a state is a trip to the JVM: rows of this trigger wait here, the map is asked only where it holds any.
        stored = self.expected.get()
        before = expected = 0 if stored is None else stored[0]
        held = self.hold and self.early.exists()
        early: dict[int, str] = {}
        for row in rows:
            if row.sequence == expected:
                yield Row(run_id=key[0], sequence=row.sequence, kind=row.kind, accepted=True)
                expected += 1
                while expected in early or (held and self.early.containsKey((expected,))):
                    if expected in early:
                        kind = early.pop(expected)
                    else:
                        kind = self.early.getValue((expected,))[0]
                        self.early.removeKey((expected,))
                    yield Row(run_id=key[0], sequence=expected, kind=kind, accepted=True)
                    expected += 1
            elif row.sequence > expected and row.sequence not in early and not (held and self.early.containsKey((row.sequence,))):
                early[row.sequence] = row.kind
            else:
                yield Row(run_id=key[0], sequence=row.sequence, kind=row.kind, accepted=False)
        for sequence, kind in early.items():
            if self.hold:
                self.early.updateValue((sequence,), (kind,))
            else:
                yield Row(run_id=key[0], sequence=sequence, kind=kind, accepted=False)
        if stored is None or expected != before:
            self.expected.update((expected,))

    def close(self) -> None:
        pass


def check_sequence(events: DataFrame, hold: bool = False) -> DataFrame:
    """``run_id, sequence, kind, accepted``: an event is accepted only as the successor of the last one.

    Events are taken one by one; those that come before their turn wait in a map by sequence and are let through, in
    order, once the missing event arrives. At the end of a trigger the ones still waiting are rejected, or kept for later
    triggers with ``hold``, so that the outcome does not depend on how the journal is cut into triggers. An event of a
    sequence that was accepted or waits already is rejected.
    """
    layout = "run_id STRING, sequence BIGINT, kind STRING, accepted BOOLEAN"
    fields = events.select("run_id", "sequence", "kind")
    return fields.groupBy("run_id").transformWithState(_Sequence(hold), layout, "append", "none")


class _Steps(StatefulProcessor):
    """One typed value per key, led through the rows of a trigger in order of their sequence.

    Keys are actions or problems: what is sorted is one key's rows of one trigger, which maxFilesPerTrigger bounds.
    """

    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state)

    def step(self, value: tuple | None, row: Row) -> tuple[tuple | None, Row | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = value = tuple(self.value.get()) if self.value.exists() else None
        for row in sorted(rows, key=lambda r: r.sequence):
            value, out = self.step(value, row)
            if out is not None:
                yield out
        if value != before:
            self.value.update(value)

    def close(self) -> None:
        pass


def dedupe_actions(events: DataFrame, fingerprint: str = "fingerprint", watermark: str | None = None, event_time: str = "timestamp") -> DataFrame:
    """First event per run and action fingerprint.

    State grows with the fingerprints unless a watermark bounds it; then a repeat that comes later
    than the watermark passes again.
    """
    if watermark is None:
        return events.dropDuplicates(["run_id", fingerprint])
    return events.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["run_id", fingerprint])


class _Live(_Steps):
    """The generation of an action that is admitted and not finished; -1 for none."""

    state = "generation BIGINT"

    def step(self, value, row):
        live = -1 if value is None else value[0]
        if row.kind in ADMITTED:
            return (row.action_generation,), row
        if row.action_generation != live:
            return value, None
        return ((-1,) if row.kind in TOOL_ENDS else value), row


def drop_stale(events: DataFrame) -> DataFrame:
    """Keep action events only while their generation is the admitted, unfinished one of its action."""
    layout = "run_id STRING, action_id STRING, action_generation BIGINT, sequence BIGINT, kind STRING"
    acting = events.filter(F.col("action_id").isNotNull()).select(
        F.col("run_id").cast("string"), F.col("action_id").cast("string"), F.col("action_generation").cast("bigint"), F.col("sequence").cast("bigint"), "kind"
    )
    return acting.groupBy("run_id", "action_id").transformWithState(_Live(), layout, "append", "none")


class _Best(_Steps):
    """The comparator of a problem's incumbent."""

    state = "comparator ARRAY<DOUBLE>"

    def step(self, value, row):
        reason = "validation_failed" if not row.valid else "infeasible" if not row.feasible else None
        new = [float(v) for v in row.comparator]
        if reason is None and value is not None and not self.better(new, value[0]):
            reason = "not_better"
        out = Row(problem_hash=row.problem_hash, sequence=row.sequence, outcome="rejected" if reason else "committed", reason=reason)
        return (value if reason else (new,)), out

    @staticmethod
    def better(new: list[float], old: list[float]) -> bool:
        for a, b in zip(new, old):
            if abs(a - b) > TOLERANCE:
                return a > b
        return False


def stream_incumbents(candidates: DataFrame) -> DataFrame:
    """Commit or reject each candidate of a problem: ``problem_hash, sequence, outcome, reason``.

    Candidates hold problem_hash, sequence, valid, feasible and comparator ARRAY<DOUBLE>. Only a
    feasible strict improvement is committed; the state is one comparator per problem.
    """
    layout = "problem_hash STRING, sequence BIGINT, outcome STRING, reason STRING"
    fields = candidates.select("problem_hash", "sequence", "valid", "feasible", "comparator")
    return fields.groupBy("problem_hash").transformWithState(_Best(), layout, "append", "none")


def stream_budget(usage: DataFrame, max_tokens: int, max_tool_calls: int) -> DataFrame:
    """Tokens and tool calls used and left per run, with an over-limit flag (update or complete mode).

    ``usage``: run_id, tokens, tool_calls per event.
    """
    spent = usage.groupBy("run_id").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_used"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_calls_used")
    )
    return spent.withColumns(
        {
            "tokens_left": F.greatest(F.lit(max_tokens) - F.col("tokens_used"), F.lit(0)),
            "tool_calls_left": F.greatest(F.lit(max_tool_calls) - F.col("tool_calls_used"), F.lit(0)),
            "over_limit": (F.col("tokens_used") > max_tokens) | (F.col("tool_calls_used") > max_tool_calls),
        }
    )


class _Started(_Steps):
    """The latest start of an action generation that no terminal event has ended."""

    state = "ms BIGINT, tool STRING"

    def step(self, value, row):
        if row.kind == "tool_started":
            return (row.ms, row.tool), None
        if value is None or value[0] is None:
            return value, None
        spent = None if row.ms is None else max(row.ms - value[0], 0)
        return (None, None), Row(run_id=row.run_id, action_id=row.action_id, action_generation=row.action_generation, sequence=row.sequence, tool=value[1], latency_ms=spent)


def stream_latency(events: DataFrame) -> DataFrame:
    """Finished tool calls: ``run_id, action_id, action_generation, sequence, tool, latency_ms``, as ``tool_latency`` gives them.

    A terminal event ends the latest earlier start of its action generation, once. The state is one start per generation;
    events of a generation must arrive in order from trigger to trigger.
    """
    layout = "run_id STRING, action_id STRING, action_generation BIGINT, sequence BIGINT, tool STRING, latency_ms BIGINT"
    calls = events.filter(F.col("action_id").isNotNull() & F.col("action_generation").isNotNull() & F.col("kind").isin("tool_started", *TOOL_ENDS)).select(
        F.col("run_id").cast("string"), F.col("action_id").cast("string"), F.col("action_generation").cast("bigint"), F.col("sequence").cast("bigint"), "kind",
        F.col("relative_monotonic_ms").cast("bigint").alias("ms"), F.coalesce(F.get_json_object("payload", "$.tool"), F.lit("unknown")).alias("tool"),
    )
    return calls.groupBy("run_id", "action_id", "action_generation").transformWithState(_Started(), layout, "append", "none")


def redact_stream(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads with sensitive values masked; stateless."""
    return events.withColumn(payload, redact_json(payload))
