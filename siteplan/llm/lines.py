"""Recurring lines of prompts: a fixed-depth tree of line templates, counted across records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import stage

FIELD = "<*>"
#: Leaves up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_LEAVES = 500_000


def masked_text(prompt: str) -> Column:
    """A prompt with single spaces inside its lines and a field mark for every word that holds a digit.

    Whole prompts are looked at first, as most need neither change. Words are tried at their start only, without
    going back.
    """
    text = F.col(prompt)
    uneven = F.contains(text, F.lit("  "))
    for space in "\t\v\f\r":
        uneven = uneven | F.contains(text, F.lit(space))
    plain = F.when(uneven, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)).otherwise(plain)


def _lines(prompts: DataFrame, depth: int) -> DataFrame:
    """Lines with a word: record, prompt hash, line number, leaf of the tree and hash of the masked line."""
    rows = prompts.select("record_id", F.xxhash64("prompt").alias("_text"), F.posexplode(F.split(masked_text("prompt"), "\n")).alias("_line", "_raw"))
    rows = rows.select("record_id", "_text", "_line", F.trim("_raw").alias("_masked")).where(F.col("_masked") != "")
    tokens = F.length("_masked") - F.length(F.replace("_masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(tokens, F.substring_index("_masked", " ", depth))
    return rows.select("record_id", "_text", "_line", leaf.alias("_leaf"), F.xxhash64("_masked").alias("_hash"), "_masked")


def _line_hashes(prompts: DataFrame, depth: int) -> DataFrame:
    """Every line as numbers, staged: whole texts are split and masked once for counting and dropping alike."""
    return stage(_lines(prompts, depth).drop("_masked"), "line-hashes")


def recurring_lines(prompts: DataFrame, min_records: int = 5, depth: int = 3, constant: float = 0.7) -> DataFrame:
    """Masked lines whose template recurs in at least ``min_records`` records.

    Returns ``line_hash``, ``template``, ``n_records`` and ``first_record``, the least record id that holds the
    template. See ``drop_recurring_lines`` for the tree.
    """
    return _recurring(prompts, _line_hashes(prompts, depth), min_records, depth, constant)


def _recurring(prompts: DataFrame, hashes: DataFrame, min_records: int, depth: int, constant: float) -> DataFrame:
    record = F.xxhash64("record_id", "_text").alias("_record")
    lines = _lines(prompts, depth).select("*", record)
    first = F.min("record_id").alias("first_record")
    seen = hashes.select("*", record).groupBy("_leaf", "_hash").agg(F.countDistinct("_record").alias("n_records"), first)
    seen = stage(seen, "line-counts")
    same = seen.where(F.col("n_records") >= min_records).select(F.col("_hash").alias("line_hash"), F.hex("_hash").alias("template"), "n_records", "first_record")

    # Sums over lines are upper bounds of distinct records and only leave out what cannot recur. A leaf whose lines all
    # recur by themselves needs no templates.
    rare = F.count(F.when(F.col("n_records") < min_records, 1)).alias("_rare")
    leaves = seen.groupBy("_leaf").agg(F.sum("n_records").alias("_n"), F.count(F.lit(1)).alias("_kinds"), rare)
    leaves = stage(leaves.where((F.col("_n") >= min_records) & (F.col("_kinds") > 1) & (F.col("_rare") > 0)).select("_leaf"), "line-leaves")
    wanted = seen.join(leaves, "_leaf", "left_semi").select("_hash", "n_records", "first_record")
    few = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    held = stage(lines.join(few, "_leaf", "left_semi").select("_leaf", "_hash", "_record", "_masked"), "line-members")
    kinds = stage(held.groupBy("_leaf", "_hash").agg(F.first("_masked").alias("_masked")).join(wanted, "_hash"), "line-kinds")
    members = held.select("_hash", "_record")

    words = kinds.select("_leaf", "_hash", "n_records", F.posexplode(F.split("_masked", " ")).alias("_at", "_word"))
    place = ["_leaf", "_at", "_word"]
    bounds = words.groupBy(*place).agg(F.sum("n_records").alias("_n"), F.max("n_records").alias("_most")).where(F.col("_n") >= min_records)
    bounds = stage(bounds, "line-words")
    unsure = words.join(bounds.where(F.col("_most") < min_records), place, "left_semi").select("_hash", *place)
    exact = members.join(unsure, "_hash").groupBy(*place).agg(F.countDistinct("_record").alias("_n")).where(F.col("_n") >= min_records).select(*place)
    steady = bounds.where(F.col("_most") >= min_records).select(*place).unionByName(exact).withColumn("_steady", F.lit(True))
    marked = words.join(steady, place, "left").withColumn("_steady", F.coalesce("_steady", F.lit(False)) & (F.col("_word") != FIELD))
    word = F.struct("_at", "_word", "_steady")
    marked = marked.groupBy("_leaf", "_hash").agg(F.array_sort(F.collect_list(word)).alias("_t"), F.avg(F.col("_steady").cast("int")).alias("_constant"))
    marked = stage(marked.select("_leaf", "_hash", F.col("_t._word").alias("_words"), F.col("_t._steady").alias("_mask"), "_constant"), "line-marks")

    # A line counts for each template of its leaf that it fits, whatever its own steady words are.
    def shown(mask: str) -> Column:
        return F.array_join(F.transform("_words", lambda w, i: F.when(F.get(mask, i), w).otherwise(F.lit(FIELD))), " ")

    made = marked.where(F.col("_constant") >= constant).select("_leaf", "_mask", shown("_mask").alias("template")).distinct()
    masks = made.select("_leaf", F.col("_mask").alias("_fit")).distinct()
    kinds_of_mask = marked.select("_leaf", "_mask").distinct()
    covers = ~F.exists(F.arrays_zip(F.col("_mask").alias("m"), F.col("_fit").alias("f")), lambda x: x["f"] & ~x["m"])
    pairs = stage(kinds_of_mask.join(masks, "_leaf").where(covers), "line-masks")
    fits = marked.join(pairs, ["_leaf", "_mask"]).select("_leaf", "_hash", shown("_fit").alias("template"))
    fits = stage(fits.join(made.select("_leaf", "template"), ["_leaf", "template"], "left_semi").join(wanted, "_hash"), "line-templates")
    totals = fits.groupBy("_leaf", "template").agg(F.sum("n_records").alias("_sum"), F.min("first_record").alias("_first")).where(F.col("_sum") >= min_records)
    totals = stage(totals, "line-totals")
    fitting = fits.join(totals.select("_leaf", "template"), ["_leaf", "template"], "left_semi").select("_hash", "_leaf", "template")
    counted = members.join(fitting, "_hash").groupBy("_leaf", "template").agg(F.countDistinct("_record").alias("_all")).where(F.col("_all") >= min_records)
    counted = counted.join(totals, ["_leaf", "template"]).select("_leaf", "template", "_all", "_first")
    best = F.max(F.struct(F.col("_all").alias("n"), F.col("template").alias("t"), F.col("_first").alias("f"))).alias("_b")
    alike = fits.join(counted, ["_leaf", "template"]).groupBy("_hash").agg(best)
    alike = stage(alike.select(F.col("_hash").alias("line_hash"), F.col("_b.t").alias("template"), F.col("_b.n").alias("n_records"), F.col("_b.f").alias("first_record")), "alike-lines")
    same = same.join(alike.select("line_hash"), "line_hash", "left_anti")
    return stage(same.unionByName(alike), "recurring-lines")


def drop_recurring_lines(prompts: DataFrame, min_records: int = 5, depth: int = 3, constant: float = 0.7) -> DataFrame:
    """Drop from case prompts (``record_id, prompt``) the lines whose template recurs across records.

    Returns all columns of ``prompts``, with ``prompt`` rebuilt from the lines that stay, and ``dropped_lines``, the
    numbers of the others. Text of a record whose lines all stay is unchanged.

    * Words with a digit are fields at once; lines fall into a leaf by their number of words and first ``depth`` words.
    * Equal masked lines are one template. In leaves that hold enough records, a word that stays at its place in
      ``min_records`` records is constant, other words are fields, and a line makes a template if a share ``constant``
      of its words is constant. Every line of the leaf that fits a template counts for it, lines that recur by
      themselves included, and a record counts once however many such lines it holds. Of several templates that
      recur a line has the one with most records.
    * A template in at least ``min_records`` records recurs. Its least record id keeps its lines, so the text of a
      group of copies is not lost; all others lose them.

    Lines are counted before they are compared: a line, a leaf or a record with many copies is a number, not a group in
    one task. Rows equal in id and prompt are one record and treated alike. A null prompt stays null with no dropped
    lines, blank lines stay, null record ids are never first unless all are null, empty input gives no rows.
    """
    lines = _line_hashes(prompts, depth)
    bad = _recurring(prompts, lines, min_records, depth, constant).select("line_hash", "first_record")
    hit = lines.drop("_leaf").join(bad, F.col("_hash") == F.col("line_hash")).where(~F.col("record_id").eqNullSafe(F.col("first_record")))
    hit = hit.groupBy(F.col("record_id").alias("_id"), F.col("_text").alias("_of")).agg(F.array_sort(F.collect_set("_line")).alias("_dropped"))
    hit = stage(hit, "dropped-lines")
    same = prompts["record_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(prompts["prompt"]) == F.col("_of"))
    joined = prompts.join(hit, same, "left")
    kept = F.array_join(F.filter(F.split("prompt", "\n"), lambda line, i: ~F.array_contains("_dropped", i)), "\n")
    dropped = F.coalesce("_dropped", F.array().cast("array<int>"))
    others = [F.col(f"`{c}`") for c in prompts.columns if c not in ("prompt", "dropped_lines")]
    return joined.select(*others, F.when(F.col("_dropped").isNull(), F.col("prompt")).otherwise(kept).alias("prompt"), dropped.alias("dropped_lines"))
