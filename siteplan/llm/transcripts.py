"""Repair of the structure of run transcripts: the cheapest edits that make roles alternate.

A transcript is the list of chat messages of a run, ``run_id, sequence, role, content``. A repaired one reads system (at
most once, first), then user and assistant in turn, ending with the assistant; or it is empty.

Edits are searched by iterative-deepening A*: depth first in ASCII order of the edits' initials, under a cost bound that
grows to the least cost that went beyond it. A table keeps, per message and state, the cost that is known to be
insufficient from there, so that no failed state is searched again below it. The first accepting path is therefore the
cheapest one that is least in ASCII order.

Transcripts of any length: sorted messages are cut into blocks, each solved for every pair of states before and after
it. Inserted messages belong to the block of the message that follows them, so no block's edits begin another's and both
the least cost and the ASCII order carry over from blocks to chains of blocks, pieces (the messages of a run in one Arrow
batch) and runs. A run that holds a third of all messages is so many pieces in many tasks; only four by four costs and
ranks per piece meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteplan.llm.common import stage

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits, and what an undeleted truncated message adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Edits that end a transcript, by the state before them.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Messages of a block, and of a transcript that is searched as one.
BLOCK = 8
DIRECT = 32
PIECE = 4096
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60

#: A message as the search sees it: initial of its role, must be deleted, is truncated.
Seen = tuple[str, bool, bool]


def turned(state: int) -> int:
    """The state after a message whose role may be chosen: user or assistant, whichever fits."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a message that keeps its role, or None where it does not fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


class _Search:
    """IDA* over one block of messages towards one end; what it learns holds for every start."""

    def __init__(self, seen: list[Seen], end: int | None):
        self.seen, self.end = seen, end
        self.floor = [0] * (len(seen) + 1)
        for i in range(len(seen) - 1, -1, -1):
            self.floor[i] = self.floor[i + 1] + (DELETE if seen[i][1] else TRUNCATED if seen[i][2] else 0)
        self.known: dict[tuple[int, int], int] = {}
        self.path: list[str] = []

    def cheapest(self, start: int) -> tuple[int, str] | None:
        if not self._reaches(start):
            return None
        bound = self.floor[0]
        # No block needs more than all messages deleted or turned and an insertion before each of them.
        most = (DELETE + INSERT + REROLE + TRUNCATED) * (len(self.seen) + 2)
        while bound <= most:
            self.path = []
            needed = self._visit(0, start, bound)
            if needed is None:
                return bound, "".join(reversed(self.path))
            bound = needed
        return None

    def _reaches(self, start: int) -> bool:
        """Whether there is a way: nothing leads back to the first two states, and only a kept message to the second."""
        if self.end == START:
            return start == START
        if self.end == SYSTEM:
            return start == SYSTEM or start == START and any(initial == "s" and not delete for initial, delete, _ in self.seen)
        return bool(self.seen) or self.end is None or start == self.end

    def _visit(self, i: int, state: int, left: int) -> int | None:
        """None and the path where the end can be reached at a cost of ``left``; else a cost that it needs at least."""
        last = i == len(self.seen)
        if last and (state == self.end if self.end is not None else state in (START, ASSISTANT)):
            return None
        low = self.known.get((i, state), self.floor[i])
        if low > left:
            return low
        least = FAR
        for edit, cost, to, after in self._edits(i, state, last):
            needed = self._visit(to, after, left - cost) if cost <= left else self.known.get((to, after), self.floor[to])
            if needed is None:
                self.path.append(edit)
                return None
            least = min(least, cost + needed)
        self.known[i, state] = least
        return least

    def _edits(self, i: int, state: int, last: bool) -> list[tuple[str, int, int, int]]:
        if last:
            return [] if self.end is not None else [("I", INSERT, i, turned(state))]
        initial, delete, truncated = self.seen[i]
        edits = [("D", DELETE, i + 1, state), ("I", INSERT, i, turned(state))]
        if not delete:
            more = TRUNCATED if truncated else 0
            same = kept(state, initial)
            if same is not None:
                edits.append(("K", more, i + 1, same))
            edits.append(("R", REROLE + more, i + 1, turned(state)))
        return edits


def solve(seen: list[Seen]) -> tuple[int, str]:
    """Cost and edits of a whole transcript."""
    if len(seen) <= DIRECT:
        return _Search(seen, None).cheapest(START)
    tables = [block_edits(seen[i : i + BLOCK]) for i in range(0, len(seen), BLOCK)]
    found = chain([ranked(t) for t in tables], START)
    cost, end, path = finish(found)
    return cost, "".join(t[step][1] for t, step in zip(tables, path, strict=True)) + ENDS[end]


def block_edits(seen: list[Seen]) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and edits of a block from each state to each other, where there is a way."""
    table = {}
    for end in STATES:
        search = _Search(seen, end)
        for start in STATES:
            if (found := search.cheapest(start)) is not None:
                table[start, end] = found
    return table


def ranked(table: dict[tuple[int, int], tuple[int, str]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Cost and place in ASCII order among the edits from the same state."""
    ranks = {}
    for start in STATES:
        ends = sorted((e for s, e in table if s == start), key=lambda e: table[start, e][1])
        ranks |= {(start, e): (table[start, e][0], k) for k, e in enumerate(ends)}
    return ranks


def chain(tables: list[dict[tuple[int, int], tuple[int, int]]], start: int) -> dict[int, tuple[int, int, tuple]]:
    """Cheapest ways through ``ranked`` tables: per end its cost, its place in ASCII order, and the steps, last first."""
    ways: dict[int, tuple[int, int, tuple]] = {start: (0, 0, ())}
    for table in tables:
        best: dict[int, tuple[int, tuple[int, int], tuple]] = {}
        for (a, b), (cost, rank) in table.items():
            if a in ways:
                way = (ways[a][0] + cost, (ways[a][1], rank), ((a, b), ways[a][2]))
                if b not in best or way[:2] < best[b][:2]:
                    best[b] = way
        order = {place: k for k, place in enumerate(sorted(w[1] for w in best.values()))}
        ways = {b: (cost, order[place], steps) for b, (cost, place, steps) in best.items()}
    return ways


def finish(ways: dict[int, tuple[int, int, tuple]]) -> tuple[int, int, list[tuple[int, int]]]:
    """Cost with the closing insertions, last state, and the steps in order of the best way."""
    cost, _, end, steps = min((cost + INSERT * len(ENDS[end]), place, end, steps) for end, (cost, place, steps) in ways.items())
    return cost, end, listed(steps)


def listed(steps: tuple) -> list[tuple[int, int]]:
    path = []
    while steps:
        step, steps = steps
        path.append(step)
    return path[::-1]


COUNTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_sequence long, last_sequence long, first string, last string"
PIECES = (
    f"part int, piece int, whole boolean, {COUNTS}, cost long, edits string, costs array<int>, ranks array<int>, ways array<string>, "
    "messages array<struct<sequence: long, role: string, digest: string>>"
)
STEPS = "part int, piece int, way int, state int, close string, final boolean, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"
LEFT = "part int, piece int, place int, edit string, role string, sequence long, own_role string, digest string"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _counts(rows: list[dict], before: tuple | None) -> tuple[dict, list[Seen]]:
    """Counts of a piece and its messages as the search sees them; ``before`` is the key of the message before it in the batch."""
    seen: list[Seen] = []
    blank = duplicate = truncated = 0
    for row in rows:
        key = (row["sequence"], row["role"], row["digest"])
        again = row["again"] or key == before
        before = key
        if row["blank"]:
            blank += 1
        elif again:
            duplicate += 1
        elif row["truncated"]:
            truncated += 1
        seen.append((row["role"][:1], row["blank"] or again, row["truncated"] and not row["blank"] and not again))
    turns = [r["sequence"] for r in rows if r["sequence"] is not None]
    initials = [s[0] for s in seen]
    return {
        "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(initials), "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns)), "first_sequence": rows[0]["sequence"], "last_sequence": rows[-1]["sequence"], "first": initials[0], "last": initials[-1],
    }, seen


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pieces of sorted messages; a run that neither begins nor ends its batch is solved at once."""
    number = 0
    for batch in batches:
        runs, rows = batch.column("run_id"), batch.drop_columns(["run_id"]).to_pylist()
        keys = runs.to_pylist()
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        firsts, out = [], []
        for at, to in zip(edges, edges[1:], strict=False):
            inside = 0 < at and to < len(keys)
            for start in range(at, to, PIECE):
                part = rows[start : min(start + PIECE, to)]
                whole = inside and len(part) == to - at
                before = None if start == at else tuple(rows[start - 1][k] for k in ("sequence", "role", "digest"))
                counts, seen = _counts(part, before)
                piece = {"part": part[0]["part"], "piece": number, "whole": whole, **counts, "cost": None, "edits": None, "costs": None, "ranks": None, "ways": None}
                if whole:
                    piece["cost"], piece["edits"] = solve(seen)
                else:
                    tables = [block_edits(seen[i : i + BLOCK]) for i in range(0, len(seen), BLOCK)]
                    joined: dict[tuple[int, int], tuple[int, str]] = {}
                    for state in STATES:
                        for end, (cost, _, steps) in chain([ranked(t) for t in tables], state).items():
                            joined[state, end] = cost, "".join(t[s][1] for t, s in zip(tables, listed(steps), strict=True))
                    ranks = ranked(joined)
                    pairs = [(a, b) for a in STATES for b in STATES]
                    piece["costs"] = [ranks[p][0] if p in ranks else None for p in pairs]
                    piece["ranks"] = [ranks[p][1] if p in ranks else None for p in pairs]
                    piece["ways"] = [joined[p][1] if p in joined else None for p in pairs]
                piece["messages"] = [{k: r[k] for k in ("sequence", "role", "digest")} for r in part]
                firsts.append(start)
                out.append(piece)
                number += 1
        rest = pa.RecordBatch.from_pylist(out, schema=pa.schema([f for f in schema if f.name != "run_id"]))
        yield pa.RecordBatch.from_arrays([runs.take(pa.array(firsts, pa.int64())).cast(schema.field("run_id").type), *rest.columns], schema=schema)


def _joined(run: pd.DataFrame) -> pd.DataFrame:
    """The steps of one run through its pieces; the counts of the whole run are on its last piece."""
    run = run.sort_values(["part", "piece"], kind="stable", ignore_index=True)
    pairs = [(a, b) for a in STATES for b in STATES]
    tables = []
    for costs, ranks in zip(run["costs"], run["ranks"], strict=True):
        tables.append({p: (int(c), int(r)) for p, c, r in zip(pairs, costs, ranks, strict=True) if c is not None and c == c})
    cost, end, path = finish(chain(tables, START))
    out = run[["run_id", "part", "piece"]].copy()
    out["way"] = [4 * a + b for a, b in path]
    out["state"] = [a for a, _ in path]
    out["close"] = [""] * (len(run) - 1) + [ENDS[end]]
    out["final"] = [False] * (len(run) - 1) + [True]
    out["cost"] = cost
    for name in ("blank", "duplicate", "truncated"):
        out[name] = int(run[name].sum())
    between = sum(a + b not in ("su", "ua", "au") for a, b in zip(run["last"], run["first"].iloc[1:], strict=False))
    out["illegal"] = int(run["illegal"].sum()) + between
    # A sequence number shared by neighbouring pieces was counted in both.
    shared = sum(a == b for a, b in zip(run["last_sequence"], run["first_sequence"].iloc[1:], strict=False))
    low, high = run["low"].min(), run["high"].max()
    out["gaps"] = 0 if pd.isna(low) else int(high - low + 1 - (run["turns"].sum() - shared))
    return out


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The messages that are left of each piece, with the inserted ones."""
    for batch in batches:
        taken, out = [], []
        for at, row in enumerate(batch.drop_columns(["run_id"]).to_pylist()):
            state, messages, place = row["state"], iter(row["messages"]), 0
            for edit in row["edits"]:
                message = None if edit == "I" else next(messages)
                if edit == "D":
                    continue
                state = kept(state, message["role"][:1]) if edit == "K" else turned(state)
                role = message["role"] if edit == "K" else ROLES[state]
                taken.append(at)
                out.append({
                    "part": row["part"], "piece": row["piece"], "place": place, "edit": edit, "role": role, "sequence": message and message["sequence"],
                    "own_role": message and message["role"], "digest": message and message["digest"],
                })
                place += 1
        rest = pa.RecordBatch.from_pylist(out, schema=pa.schema([f for f in schema if f.name != "run_id"]))
        runs = batch.column("run_id").take(pa.array(taken, pa.int64())).cast(schema.field("run_id").type)
        yield pa.RecordBatch.from_arrays([runs, *rest.columns], schema=schema)


def _shape(messages: DataFrame, rest: str) -> tuple[T.StructType, pa.Schema]:
    """The run id as ``messages`` has it and the columns ``rest``, for Spark and for Arrow."""
    shape = T.StructType([T.StructField("run_id", messages.schema["run_id"].dataType), *T.StructType.fromDDL(rest).fields])
    return shape, to_arrow_schema(shape)


def repair_transcripts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair the transcripts of runs: ``(report, repaired)``.

    ``messages`` holds ``run_id, sequence, role, content``; other columns are ignored. The messages of a run are taken by
    sequence (nulls first), then role, then the first 32 characters and a digest of the content. A null role or content
    counts as one space; a null run is a run of its own. A message is blank (nothing but white space), else a duplicate
    (its role and content came earlier in the run, equal rows included), else truncated (its last other character is not
    one of ``.!?``), else clean. Edits: keep (0), rerole to user or assistant (3), delete (4; blank and duplicate
    messages must go), insert an empty message of user or assistant (3); an undeleted truncated message adds 3.

    ``report``: per run ``gaps`` (sequence numbers missing between its least and greatest), ``blank, duplicate,
    truncated``, ``illegal`` (neighbours whose roles' initials are not su, ua or au), ``cost`` and ``audit``, the initials
    of the cheapest edits in order, least in ASCII order among equals. ``repaired``: the messages that are left,
    ``run_id, part, piece, place, edit, sequence, role, content``, in order of run, part, piece and place. Runs without
    messages have no rows in either; an empty table has none at all.

    Content is read twice and shuffled once, with the repaired messages; everything else is sorted without it.
    """
    space = F.lit(" ")
    read = messages.select(
        "run_id", F.col("sequence").cast("long").alias("sequence"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("content"), space).alias("content")
    ).withColumn("digest", F.sha2("content", 256))
    trimmed = F.rtrim(F.col("content"), F.lit(WHITE))
    slim = read.select(
        "run_id", "sequence", "role", "digest", F.substring("content", 1, 32).alias("opening"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    same = ["run_id", "role", "digest"]
    repeats = slim.groupBy(*same).agg(F.min(F.struct("sequence")).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    repeats = repeats.select(*[F.col(c).alias(f"_{c}") for c in same], "_first")
    on = F.col("run_id").eqNullSafe(F.col("_run_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.col("_first").isNotNull() & ~F.col("sequence").eqNullSafe(F.col("_first.sequence"))
    marked = slim.join(repeats, on, "left").select("run_id", "sequence", "role", "opening", "digest", "blank", "truncated", again.alias("again"))
    order = ["run_id", "sequence", "role", "opening", "digest"]
    # Equal rows stay together, so the second of them sees the first before it.
    sorted_ = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("opening").withColumn("part", F.spark_partition_id())
    shape, arrow = _shape(messages, PIECES)
    pieces = stage(sorted_.mapInArrow(lambda batches: _pieces(batches, arrow), shape), "pieces")

    open_ = pieces.where(~F.col("whole")).drop("messages", "ways", "edits", "cost", "whole")
    steps = open_.groupBy("run_id").applyInPandas(_joined, _shape(messages, STEPS)[0])
    ways = pieces.where(~F.col("whole")).select("part", "piece", "ways", "messages")
    steps = stage(
        steps.join(ways, ["part", "piece"]).withColumn("edits", F.concat(F.element_at("ways", F.col("way") + 1), "close")).drop("ways", "way", "close"), "steps"
    )
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    spread = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    solved = pieces.where("whole").select("run_id", spread, *figures[1:], F.col("edits").alias("audit"))
    texts = F.array_sort(F.collect_list(F.struct("part", "piece", "edits")))
    audits = steps.groupBy("run_id").agg(
        *[F.max(F.when(F.col("final"), F.col(c))).alias(c) for c in figures], F.array_join(F.transform(texts, lambda t: t["edits"]), "").alias("audit")
    )
    report = solved.unionByName(audits)

    left, left_arrow = _shape(messages, LEFT)
    planned = ["run_id", "part", "piece", "state", "edits", "messages"]
    edits = pieces.where("whole").withColumn("state", F.lit(START)).select(*planned).unionByName(steps.select(*planned))
    rows = edits.mapInArrow(lambda batches: _repaired(batches, left_arrow), left)
    contents = read.groupBy(*same).agg(F.first("content").alias("content")).select(*[F.col(c).alias(f"_{c}") for c in same], "content")
    on = F.col("run_id").eqNullSafe(F.col("_run_id")) & (F.col("own_role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    repaired = rows.join(contents, on, "left").select("run_id", "part", "piece", "place", "edit", "sequence", "role", F.coalesce("content", F.lit("")).alias("content"))
    return report, repaired


def transcript_digests(repaired: DataFrame) -> DataFrame:
    """``run_id, sha256``: digest of a run's messages as ``role:content``, newline-joined, in order.

    A digest is one pass over a run in order, so a run's messages go through one task; they stream through it, sorted on
    disk, and only the state of the digest is held.
    """
    kind, schema = _shape(repaired, "sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            runs, done = [], []
            for run, role, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or run != key:
                    if state is not None:
                        runs.append(key)
                        done.append(state.hexdigest())
                    key, state = run, hashlib.sha256()
                    state.update(f"{role}:{content}".encode())
                else:
                    state.update(f"\n{role}:{content}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(runs, schema.field(0).type), pa.array(done, pa.string())], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], schema.field(0).type), pa.array([state.hexdigest()])], schema=schema)

    ordered = repaired.repartition("run_id").sortWithinPartitions("run_id", "part", "piece", "place")
    return ordered.select("run_id", "role", "content").mapInArrow(digest, kind)
