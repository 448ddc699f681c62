"""Mixing datasets of evaluation cases to target weights by systematic sampling.

Native: DataFrame functions only. Ranks come from the two-level ordered operators, so a dataset that
holds a third of the rows is spread over range buckets; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import stage
from siteplan.operators.ordered import positions, running

#: Expected copies and offsets are whole numbers of this many parts, so that no sum is rounded.
PARTS = 10**12
SEED = "mix"


def word_count(prompt: Column | str) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(prompt, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def dataset_targets(records: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 2.0) -> DataFrame:
    """``dataset, dataset_words, weight, target``: the words that the mix should take from each dataset.

    Datasets in code-point order, null last, take ``weights`` in turn, from the front again when they run out.
    ``share`` times all words are dealt by weight; no target exceeds ``most`` times its dataset's words, and what
    that frees goes to the others by weight. With a level ``L`` the targets are ``least(most * words, L * weight)``;
    their sum is the least over all prefixes, in order of ``most * words / weight``, of the prefix's caps plus ``L``
    times the other weights, so ``L`` is the greatest of the levels that single prefixes ask for.
    Needs ``dataset, n_words``; an empty table has no rows, datasets without words have target 0.
    """
    if not weights or min(weights) <= 0 or share < 0 or most <= 0 or share > most:
        raise ValueError("weights and most must be positive, and share between 0 and most")
    sizes = records.groupBy("dataset").agg(F.sum(F.coalesce("n_words", F.lit(0))).cast("long").alias("dataset_words"))
    keyed = sizes.select("*", F.col("dataset").isNull().alias("_null"), F.coalesce("dataset", F.lit("")).alias("_name"))
    turn = positions(keyed, [], ["_null", "_name"], name="_turn")
    choices = F.array(*[F.lit(float(w)) for w in weights])
    capped = turn.withColumn("weight", F.element_at(choices, ((F.col("_turn") - 1) % len(weights) + 1).cast("int")))
    capped = capped.withColumn("_cap", F.lit(float(most)) * F.col("dataset_words")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    capped = stage(capped.drop("_null", "_name"), "datasets")
    before = running(capped, [], ["_ratio", "_turn"], {"_caps": ("sum", F.col("_cap")), "_weights": ("sum", F.col("weight"))}, inclusive=False)
    whole = capped.agg(F.struct((F.lit(float(share)) * F.sum("dataset_words")).alias("words"), F.sum("weight").alias("weight")).alias("w"))
    asked = before.withColumn("_w", whole.scalar()).agg(
        F.max((F.col("_w.words") - F.coalesce("_caps", F.lit(0.0))) / (F.col("_w.weight") - F.coalesce("_weights", F.lit(0.0)))).alias("level")
    )
    level = capped.withColumn("_level", asked.scalar())
    return level.select("dataset", "dataset_words", "weight", F.least("_cap", F.col("_level") * F.col("weight")).alias("target"))


def _offset(dataset: Column, seed: str) -> Column:
    """One offset per dataset, below ``PARTS``, from a digest of the seed and the name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(dataset, F.lit("")))), 1, 12), 16, 10).cast("long") % PARTS


def mix_datasets(records: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """Systematic sampling of evaluation records: how often the mix takes each one.

    ``records`` holds ``record_id, dataset, n_words`` and any other columns. Every record of a dataset is expected
    ``target / dataset_words`` times. Records are put in order of size, then of a digest of seed and id; the expected
    copies are added up along that order from one offset per dataset, and a record is taken once for each whole
    number that the sum passes. So a record is taken its expected number of times, rounded up or down, and because
    neighbours in the order are alike in size, the words taken from a dataset miss its target by less than about its
    largest record. Sums are of whole numbers: reruns agree, whatever the partitions.

    Returns all columns with ``dataset_words, target, copies`` (int) and ``taken`` (long, words). The records are
    written once to the shared folder and read three times; pass ids and sizes, not texts, and join texts later.
    A null dataset is one of its own, null and negative sizes count as 0, equal rows are separate records (which of
    rows equal in all columns is taken more often is undefined), records of a dataset without words are never taken.
    A column that has the name of one added here gives way to it; an empty table has no rows.
    """
    added = ("dataset_words", "target", "copies", "taken")
    kept = [c for c in records.columns if c not in added]
    hashable = [F.col(f"`{f.name}`") for f in records.schema if f.name in kept and "map<" not in f.dataType.simpleString()]
    rows = stage(
        records.select(
            *[F.col(f"`{c}`") for c in kept if c != "n_words"],
            F.greatest(F.coalesce(F.col("n_words").cast("long"), F.lit(0)), F.lit(0)).alias("n_words"),
            F.col("dataset").isNull().alias("_null"), F.coalesce("dataset", F.lit("")).alias("_name"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).alias("_digest"),
            F.xxhash64(*hashable).alias("_row"),
        ),
        "mix",
    )
    targets = dataset_targets(rows, weights, share, most)
    each = F.when(F.col("dataset_words") > 0, F.floor(F.col("target") * PARTS / F.col("dataset_words"))).otherwise(F.lit(0)).cast("long")
    sources = stage(
        targets.select(
            F.col("dataset").isNull().alias("_null"), F.coalesce("dataset", F.lit("")).alias("_name"), "dataset_words", "target",
            each.alias("_each"), _offset(F.col("dataset"), seed).alias("_offset"),
        ),
        "targets",
    )
    keys = ["_null", "_name"]
    ranked = positions(rows, keys, ["n_words", "_digest", "_row"], name="_place").join(sources, keys)

    def passed(rank: str) -> Column:
        return F.expr(f"(cast({rank} as decimal(20,0)) * cast(_each as decimal(14,0)) + cast(_offset as decimal(14,0))) div {PARTS}")

    copies = (passed("_place") - passed("_place - 1")).cast("int")
    mixed = ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("n_words"))
    return mixed.select(*[F.col(f"`{c}`") for c in kept], *added)


def taken_copies(mixed: DataFrame) -> DataFrame:
    """One row per taken copy of the records of ``mix_datasets``, numbered from 1 in ``copy``."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
