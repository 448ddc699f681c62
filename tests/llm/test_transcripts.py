"""Repair of run transcripts: the search against Dijkstra, whole tables against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random

import pytest

from siteplan.llm import transcripts
from siteplan.llm.queries import QUERIES
from siteplan.llm.transcripts import kept, repair_transcripts, solve, transcript_digests, turned

SCHEMA = "run_id string, sequence long, role string, content string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(seen) -> tuple[int, str]:
    """Least (cost, edits) by Dijkstra over pairs of both."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, path, i, state = heapq.heappop(heap)
        if i == len(seen) and state in (0, 3):
            return cost, path
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 3, path + "I", i, turned(state)))
        if i < len(seen):
            initial, delete, truncated = seen[i]
            heapq.heappush(heap, (cost + 4, path + "D", i + 1, state))
            if not delete:
                more = 3 if truncated else 0
                if (same := kept(state, initial)) is not None:
                    heapq.heappush(heap, (cost + more, path + "K", i + 1, same))
                heapq.heappush(heap, (cost + more + 3, path + "R", i + 1, turned(state)))


@pytest.mark.parametrize("direct, block", [(32, 8), (0, 1), (0, 2), (0, 3)])
def test_search(monkeypatch, direct, block):
    monkeypatch.setattr(transcripts, "DIRECT", direct)
    monkeypatch.setattr(transcripts, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        seen = [(rng.choice("suaut "), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        assert solve(seen) == cheapest(seen)


def expected(rows) -> dict:
    runs: dict = {}
    for run, sequence, role, content in rows:
        runs.setdefault(run, []).append((sequence, " " if role is None else role, " " if content is None else content))
    out = {}
    for run, own in runs.items():
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2][:32], hashlib.sha256(m[2].encode()).hexdigest()))
        earlier, seen, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, content in own:
            words = content.rstrip(WHITE)
            fault = "blank" if not words else "duplicate" if (role, content) in earlier else "truncated" if words[-1] not in ".!?" else None
            earlier.add((role, content))
            if fault:
                faults[fault] += 1
            seen.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [s[0] for s in seen]
        turns = [m[0] for m in own if m[0] is not None]
        cost, audit = cheapest(seen)
        state, left, messages = 0, [], iter(own)
        for edit in audit:
            _, role, content = (None, "", "") if edit == "I" else next(messages)
            if edit != "D":
                state = kept(state, role[:1]) if edit == "K" else turned(state)
                left.append(f"{role if edit == 'K' else transcripts.ROLES[state]}:{content}")
        out[run] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(left).encode()).hexdigest() if left else None,
        )
    return out


def found(messages) -> dict:
    report, repaired = repair_transcripts(messages)
    digests = {r.run_id: r.sha256 for r in transcript_digests(repaired).collect()}
    return {
        r.run_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.run_id)) for r in report.collect()
    }


def messages_of(rng, n: int, runs) -> list:
    contents = ["Where to open a clinic?", "At site a.", "At site a", "", None, " \n", "ok", "Yes! ", "a" * 40 + "1.", "a" * 40 + "2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(rng.choice(runs), rng.choice([None, *range(-3, 25)]), rng.choice(roles), rng.choice(contents)) for _ in range(n)]


def test_tables_against_plain_python(spark):
    rng = random.Random(11)
    rows = messages_of(rng, 400, [None, "", "a", "b", *map(str, range(40))])
    rows += rows[:30]
    rows += [("long", 0, "user", "word " * 60_000 + "?"), ("long", 1, "assistant", "word " * 60_000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_a_run_over_many_pieces(spark, monkeypatch):
    """A run that holds most messages goes through many batches and tasks; the result is that of one search."""
    rng = random.Random(12)
    hot = [("hot", i // 3, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["yes.", f"no {i}.", "", f"cut {i}"])) for i in range(600)]
    rows = hot + messages_of(rng, 60, ["a", "b", "c"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_and_clashing(spark):
    report, repaired = repair_transcripts(spark.createDataFrame([], SCHEMA))
    assert report.collect() == [] and repaired.collect() == [] and transcript_digests(repaired).collect() == []
    rows = [(1, 0, "user", "Hello.", 5, "x"), (1, 1, "assistant", "Hi.", 6, "y")]
    clashing = spark.createDataFrame(rows, "run_id int, sequence int, role string, content string, part int, digest string")
    report, repaired = repair_transcripts(clashing)
    assert [(r.run_id, r.audit, r.cost) for r in report.collect()] == [(1, "KK", 0)]
    assert [(r.role, r.content) for r in repaired.orderBy("place").collect()] == [("user", "Hello."), ("assistant", "Hi.")]


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "Fine.") for c in range(60) for t in range(1 + c % 4)] + [(None, None, None, None), (7, None, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(out) == {None, *range(60)}
    # Rows that the fault drops leave zeros, an empty audit and the digest of nothing.
    import zlib

    gone = [c for c in range(60) if c % 4 == 0 and c != 7 and zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    for c in gone:
        assert out[c].audit == "" and out[c].cost == 0 and out[c].repaired_sha256 == hashlib.sha256(b"").hexdigest()
