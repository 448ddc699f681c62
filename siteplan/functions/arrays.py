"""Counting and addressing combinations with column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = 4.0e18


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a DOUBLE (exact up to 2^53); 0 outside 0 <= k <= n."""
    steps = F.sequence(F.lit(1).cast("bigint"), F.greatest(k.cast("bigint"), F.lit(1).cast("bigint")))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: F.round(acc * (n - k + i) / i))
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.least(product, F.lit(BIG)))


def combination_at(n: Column, size: Column, index: Column) -> Column:
    """The ``index``-th ``size``-subset of range(n) in lexicographic order, as an ascending array."""
    empty = F.array().cast("array<bigint>")
    seed = F.struct(index.cast("double").alias("k"), size.cast("bigint").alias("left"), empty.alias("picked"))

    def step(state: Column, x: Column) -> Column:
        block = choose(n - x - 1, state["left"] - 1)
        taken = F.struct(
            state["k"].alias("k"), (state["left"] - 1).alias("left"), F.concat(state["picked"], F.array(x)).alias("picked")
        )
        passed = F.struct((state["k"] - block).alias("k"), state["left"].alias("left"), state["picked"].alias("picked"))
        return F.when(state["left"] == 0, state).when(state["k"] < block, taken).otherwise(passed)

    places = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    return F.when(size == 0, empty).otherwise(F.aggregate(places, seed, step, lambda st: st["picked"]))


def pair_at(index: Column, n: Column) -> tuple[Column, Column]:
    """The ``index``-th pair (a, b), a < b, of range(n) in lexicographic order."""
    width = n * 2 - 1
    guess = F.floor((width - F.sqrt(F.greatest(width * width - index * 8, F.lit(0)))) / 2)
    start = lambda a: a * (width - a) / 2
    a = F.when(start(guess) > index, guess - 1).when(start(guess + 1) <= index, guess + 1).otherwise(guess)
    return a.cast("bigint"), (index - start(a) + a + 1).cast("bigint")
