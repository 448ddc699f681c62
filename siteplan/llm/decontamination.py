"""Benchmark decontamination: windows of item size, found through the shingles that any match must share and verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import stage

SHINGLE = 5
#: Item shingles up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(text: str, size: int) -> Column:
    """Hash of every run of ``size`` words of a text, in order; none if there are fewer words.

    The words are bound to a lambda variable, so they are made once however often they are used.
    """

    def of_words(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
        return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words_of(text)), of_words), F.lit(0))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array of shingle hashes, weighted by how often each occurs: a bit is 1 if most hashes have it."""
    ones = f"aggregate({hashes}, 0L, (total, h) -> total + (shiftrightunsigned(h, bit) & 1L))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (out, bit) -> out | if(2 * {ones} > size({hashes}), shiftleft(1L, bit), 0L))")


def weighted_similarity(a: str, b: str) -> Column:
    """Shared over total shingle weight of two arrays, a shingle weighing as often as it occurs."""

    def times(array: str, shingle: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == shingle))

    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, s: total + F.least(times(a, s), times(b, s)))
    return shared / (F.size(a) + F.size(b) - shared)


def find_leaks(prompts: DataFrame, cases: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Evaluation cases (``case_id, prompt``) that training prompts (``record_id, prompt``) hold, in whole or nearly.

    Returns ``record_id, prompt_hash, case_id, start, n_words, similarity``: the best window of each prompt and case. A
    window has the case's number of words and matches if its five-word shingles, weighted by how often they occur,
    overlap the case's by ``similarity`` of their total.

    1. A window can reach the similarity only if it shares a shingle with the case, so windows are laid where a
       shingle of a prompt is one of a case, in line with it. Nothing else of a prompt leaves its task.
    2. A match shares at least ``similarity`` of the case's shingles, so it holds one of any ``n - ceil(similarity * n) + 1``
       of them. Cases are listed under so many of theirs, those of least hash, and windows under all of their own: the
       join of both holds every match.
    3. These pairs are verified on the exact weighted shingles, and at least one shingle must be in line.

    Cases of fewer than five words are one shingle of all their words, met by equal runs of words. Null and empty
    cases match nothing, null and empty prompts hold nothing. Rows equal in id and prompt give one result; other
    columns are not read.
    """
    items = stage(cases.select("case_id", "prompt", F.size(words_of("prompt")).alias("_n")).distinct(), "cases").where("_n > 0")
    items = items.select("case_id", "prompt", "_n", F.least("_n", F.lit(SHINGLE)).alias("_k"))
    sizes = sorted(r["_k"] for r in items.select("_k").distinct().collect())
    of_size = [F.when(F.col("_k") == k, shingle_hashes("prompt", k)) for k in sizes] or [F.array().cast("array<bigint>")]
    items = stage(items.select("case_id", "_n", "_k", F.coalesce(*of_size).alias("_case")), "case-hashes")
    spots = stage(items.select("_n", "_k", F.posexplode("_case").alias("_offset", "_hash")).distinct(), "case-shingles")
    spots = F.broadcast(spots) if spots.count() <= BROADCAST_SHINGLES else spots

    texts = prompts.select("record_id", F.xxhash64("prompt").alias("prompt_hash"), "prompt")
    found = None
    for k in sizes:
        hashed = texts.select("record_id", "prompt_hash", shingle_hashes("prompt", k).alias("_all"))
        rows = hashed.select("record_id", "prompt_hash", "_all", F.posexplode("_all").alias("_at", "_hash"))
        hits = rows.join(spots.where(F.col("_k") == k).drop("_k"), "_hash")
        start = F.col("_at") - F.col("_offset")
        shown = F.slice("_all", F.greatest(start, F.lit(0)) + 1, F.col("_n") - (k - 1) + F.least(start, F.lit(0)))
        windows = hits.select("record_id", "prompt_hash", F.lit(k).alias("_k"), F.col("_n").alias("n_words"), start.alias("_start"), shown.alias("_window"))
        found = windows if found is None else found.unionByName(windows)
    if found is None:
        found = texts.select("record_id", "prompt_hash", F.lit(0).alias("_k"), F.lit(0).alias("n_words"), F.lit(0).alias("_start"), F.array().cast("array<bigint>").alias("_window")).limit(0)
    windows = stage(found.distinct(), "windows")

    needed = F.ceil(similarity * F.size("_case") - 1e-9).cast("int")
    some = F.array_distinct(F.slice(F.array_sort("_case"), 1, F.size("_case") - needed + 1))
    keys = stage(items.select("case_id", "_k", F.col("_n").alias("n_words"), F.explode(some).alias("_key")).distinct(), "case-keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SHINGLES else keys
    keyed = windows.select("*", F.explode(F.array_distinct("_window")).alias("_key")).join(keys, ["_key", "_k", "n_words"])
    pairs = keyed.select("record_id", "prompt_hash", "_start", "n_words", "_window", "case_id").distinct()
    pairs = pairs.join(items.select("case_id", F.col("_n").alias("n_words"), "_case").distinct(), ["case_id", "n_words"])
    in_line = F.exists(F.sequence(F.lit(0), F.size("_window") - 1), lambda i: F.get("_window", i) == F.get("_case", i - F.least("_start", F.lit(0))))
    pairs = pairs.select("*", weighted_similarity("_window", "_case").alias("similarity")).where((F.col("similarity") >= similarity) & in_line)
    pairs = pairs.select("record_id", "prompt_hash", "case_id", F.greatest("_start", F.lit(0)).alias("start"), "n_words", "similarity")
    best = pairs.groupBy("record_id", "prompt_hash", "case_id")
    chosen = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("_back"), "n_words"))
    return best.agg(chosen.alias("_b")).select("record_id", "prompt_hash", "case_id", (-F.col("_b._back")).alias("start"), "_b.n_words", "_b.similarity")


def clean_prompts(prompts: DataFrame, leaks: DataFrame) -> DataFrame:
    """The rows of ``prompts`` without a leak, with all their columns."""
    bad = leaks.select(F.col("record_id").alias("_leaked_id"), F.col("prompt_hash").alias("_leaked_hash")).distinct()
    same = prompts["record_id"].eqNullSafe(F.col("_leaked_id")) & (F.xxhash64(prompts["prompt"]) == F.col("_leaked_hash"))
    return prompts.join(bad, same, "left_anti")
