"""Pattern packing: case prompts as token sequences of one length, from a histogram of piece lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteplan.llm.common import id_bytes, stage
from siteplan.llm.encoder import encoder, slices

#: A sequence's piece lengths, and how many sequences look like that.
Pattern = tuple[tuple[int, ...], int]


class Packing(NamedTuple):
    """``pieces``: record_id, piece, start, length, token_ids and the piece's key (bucket, row);
    ``placements``: bucket, row, sequence_id, offset. Token ids are bytes, little-endian unsigned 32-bit integers, as
    training loaders map them."""

    pieces: DataFrame
    placements: DataFrame


def cut_prompts(prompts: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode ``record_id, prompt`` and cut each into pieces of at most ``capacity`` ids, as a staged table.

    The end id follows each prompt. Only longer prompts are cut: into full pieces, the first taking the rest.
    ``bucket`` is the task that made the piece, ``row`` its number there, ``length_rank`` its number there among
    pieces of its length. A null prompt is empty: one piece with the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, bucket, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        seen = np.zeros(capacity + 1, "i8")
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                offsets, ids = one.encode_column(batch.column(1).slice(lo, hi - lo), end_id)
                tokens = np.diff(offsets)
                number = -(-tokens // capacity)
                owner = np.repeat(np.arange(lo, hi), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                first = np.repeat((tokens - 1) % capacity + 1, number)
                length = np.where(piece == 0, first, capacity)
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(owner), "i8")
                rank[order] = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - seen, sizes)
                seen += sizes
                cuts = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(np.full(len(owner), bucket, "i4")), pa.array(np.arange(row, row + len(owner))), pa.array(piece.astype("i4")),
                     pa.array(start), pa.array(length), pa.array(rank), id_bytes(cuts, ids)],
                    names=["record_id", "bucket", "row", "piece", "start", "length", "length_rank", "token_ids"],
                )
                row += len(owner)

    prompts = prompts.select("record_id", "prompt")
    kind = prompts.schema["record_id"].dataType.simpleString()
    schema = f"record_id {kind}, bucket int, row long, piece int, start long, length long, length_rank long, token_ids binary"
    return stage(prompts.mapInArrow(cut, schema), "pieces")


def pack_prompts(prompts: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> Packing:
    """Pack case prompts (``record_id, prompt``) into few sequences of ``capacity`` ids.

    Patterns of one to three lengths that fill a sequence are fitted to the histogram of piece lengths by
    non-negative least squares, rounded, and what they leave is packed best fit first. The driver sees the
    histogram alone (``capacity`` numbers), so planning costs the same at any size. A piece finds its place by its
    number among the pieces of its length: its task's count so far plus the counts of earlier tasks. The plan sent to
    the tasks has at most three slots for each of the capacity^2 / 12 patterns, whatever the data. Equal lengths,
    however many, are spread over all tasks.

    Empty input gives no pieces; null and repeated records are packed like any other; other columns are not read.
    Sequence ids are gapless from 0, offsets in a sequence too.
    """
    spark = prompts.sparkSession
    pieces = cut_prompts(prompts, tokenizer, end_id, capacity)
    counts = stage(pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("_n")), "length-counts")
    histogram = np.zeros(capacity + 1, "i8")
    for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect():
        histogram[r["length"]] = r["_n"]
    slots = spark.sparkContext.broadcast(slot_table(plan_sequences(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offset = slots.value
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            key = (length << 44) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first[at] + key - keys[at]), pa.array(offset[at])], names=["bucket", "row", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("bucket", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["bucket", "length"]).select("bucket", "row", "length", (F.col("_before") + F.col("length_rank")).alias("rank"))
    return Packing(pieces, ranked.mapInArrow(place, "bucket int, row long, sequence_id long, offset long"))


def sequences(packing: Packing) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``record_ids`` and ``token_ids`` (bytes) in order of their offsets."""
    part = F.struct("offset", "record_id", "token_ids")
    return (
        packing.pieces.join(packing.placements, ["bucket", "row"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))
        .select("sequence_id", F.col("_p.record_id").alias("record_ids"), F.aggregate(F.col("_p.token_ids"), F.lit(b""), lambda joined, ids: F.concat(joined, ids)).alias("token_ids"))
    )


def fill_patterns(capacity: int) -> np.ndarray:
    """All patterns of one to three lengths that add up to ``capacity``, as rows of three lengths, 0 for none."""
    rows = [np.array([[capacity, 0, 0]], "i4")]
    a = np.arange(1, capacity // 2 + 1, dtype="i4")
    rows.append(np.stack([capacity - a, a, np.zeros_like(a)], 1))
    for c in range(1, capacity // 3 + 1):
        b = np.arange(c, (capacity - c) // 2 + 1, dtype="i4")
        rows.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 250) -> np.ndarray:
    """Non-negative least squares of repeat counts against the histogram, by accelerated projected gradients."""
    size = len(histogram)
    used = histogram.astype(float)
    used[0] = 0.0

    def spread(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(patterns.shape[1]))
        out[0] = 0.0
        return out

    def gather(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(1)

    v = np.ones(len(patterns))
    for _ in range(12):
        v = gather(spread(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - gather(spread(y) - used) / (1.05 * norm), 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_sequences(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences for a histogram of lengths 1 to ``capacity``: patterns with counts that use each piece once."""
    left = histogram.copy()
    left[0] = 0
    plan: list[Pattern] = []
    patterns = fill_patterns(capacity)
    patterns = patterns[(left[patterns] + (patterns == 0) > 0).all(1)]
    if len(patterns):
        total = np.cumsum(fit_counts(patterns, left))
        whole = np.floor(total + 0.5).astype("i8")
        counts = np.diff(whole, prepend=0)
        chosen = np.flatnonzero(counts)
        for i in chosen[np.argsort(-counts[chosen], kind="stable")].tolist():
            lengths = tuple(n for n in patterns[i].tolist() if n)
            n = min(int(counts[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
            if n > 0:
                plan.append((lengths, n))
                for x in lengths:
                    left[x] -= n
    return plan + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: equal open sequences are kept together, so the work follows distinct lengths."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    spaces: list[int] = []
    done: list[Pattern] = []

    def put(space: int, lengths: tuple[int, ...], n: int) -> None:
        if space == 0:
            done.append((lengths, n))
            return
        if space not in open_:
            open_[space] = {}
            bisect.insort(spaces, space)
        open_[space][lengths] = open_[space].get(lengths, 0) + n

    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                if n >= fit:
                    put(capacity - fit * length, (length,) * fit, n // fit)
                if n % fit:
                    put(capacity - n % fit * length, (length,) * (n % fit), 1)
                break
            space = spaces[at]
            lengths, have = next(iter(open_[space].items()))
            take = min(n, have)
            n -= take
            if have == take:
                del open_[space][lengths]
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                open_[space][lengths] = have - take
            put(space - length, (*lengths, length), take)
    return done + [(lengths, n) for group in open_.values() for lengths, n in group.items()]


def slot_table(plan: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a plan sorted by length: (length << 44) + rank of the first piece, its sequence, the offset."""
    length, first, count, offset = [], [], [], []
    base = 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            length.append(x)
            first.append(base)
            count.append(n)
            offset.append(at)
            at += x
        base += n
    length, first, count, offset = (np.array(x, "i8") for x in (length, first, count, offset))
    order = np.argsort(length, kind="stable")
    length, first, count, offset = length[order], first[order], count[order], offset[order]
    total = np.cumsum(count) - count
    start = np.searchsorted(length, length, side="left")
    rank = total - total[start] if len(total) else total
    return (length << 44) + rank, first, offset
