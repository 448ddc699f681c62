"""Uniform shuffle of records into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteplan.llm.common import stage

#: Records of a shard that one task permutes in the second step, about.
BUCKET_ROWS = 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` of ``good + bad``: inversion outwards from the mode, so steps follow the spread."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def choices(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    left = right = mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p_left = p_right = exp(choices(good, mode) + choices(bad, draws - mode) - choices(good + bad, draws))
    u = rng.random() - p_left
    while u >= 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u < 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u < 0:
                return left
    return mode


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard: the law of a uniform permutation cut into nearly equal shards.

    Row sums are the blocks' sizes, column sums the shards' sizes (at most one apart).
    """
    rng, total = random.Random(seed), sum(block_rows)
    free = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for rows in block_rows:
        rest, sent = sum(free), []
        for j in range(shards):
            rest -= free[j]
            sent.append(hypergeometric(rng, free[j], rest, rows))
            free[j] -= sent[j]
            rows -= sent[j]
        matrix.append(sent)
    return matrix


def shard_records(records: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """Shuffle ``records`` (case records with any columns) into ``shards`` shards of sizes at most one apart.

    Returns ``record`` (a struct of all columns, so none clashes), ``shard`` from 0 and ``slot``, gapless from 0 in
    each shard; every permutation of the records is equally likely up to the hash that stands for random numbers.

    1. A block is what one task reads; its rows are written down with the block's number.
    2. From the blocks' counts alone the driver draws how many rows each block sends to each shard.
    3. Each block orders its rows by a seeded hash and sends that many to each shard.
    4. Each shard is permuted again, in buckets of a second hash so that no task holds a whole shard.

    Both permutations are worked out on row numbers; the records themselves are written once and move once, to their
    places. Nothing but one count per block comes to the driver. Null values and repeated rows are shuffled like any
    other, empty input gives no rows, and with fewer records than shards the first shards take one each.
    """
    spark = records.sparkSession
    read = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_row"))
    placed = stage(read, "blocks")
    counts = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).orderBy("_block").collect()
    bounds = []
    for r, sent in zip(counts, communication_matrix([r["_n"] for r in counts], shards, seed), strict=True):
        ends, at = [], 0
        for n in sent:
            at += n
            ends.append(at)
        bounds.append((r["_block"], ends))
    ends = spark.createDataFrame(bounds, "_block int, _ends array<long>")
    local = Window.partitionBy("_block").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")
    ranked = placed.select("_block", "_row", (F.row_number().over(local) - 1).alias("_rank")).join(ends, "_block")
    buckets = max(1, -(-sum(r["_n"] for r in counts) // (shards * BUCKET_ROWS)))
    key = F.xxhash64("_row", F.lit(seed + 1))
    exchanged = stage(
        ranked.select(
            "_row", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).alias("shard"), key.alias("_key"),
            F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(buckets).cast("long"), 31).alias("_bucket"),
        ),
        "exchanged",
    )
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = exchanged.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "_row")
    places = exchanged.select("*", F.row_number().over(inside).alias("_at")).join(before, ["shard", "_bucket"]).select("_row", "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"))
    return placed.select("record", "_row").join(places, "_row").select("record", "shard", "slot")
