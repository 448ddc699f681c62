"""Spelling variants of the words of evaluation prompts, found by PartEnum signatures.

Words are taken as multisets of letters, that is as binary vectors with one place per letter and
occurrence. One inserted or deleted letter changes one place, one replaced letter two. The places are
dealt to ``PARTITIONS`` parts; vectors at distance two or less agree on all but two parts, so each vector
is listed once for every choice of two parts left out, and near vectors share a list.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import stage

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
PARTITIONS = 8
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 100_000


def drop_one_letter(every: int) -> Callable[[object, list[str]], Iterator[str]]:
    """A fault for tests of the grouping: in one of ``every`` pairs of record and word the word loses a letter.

    The pair's unsigned CRC-32 (of ``<record_id>:<word>``, a null id is empty) says whether and which.
    """

    def damaged(record_id: object, words: list[str]) -> Iterator[str]:
        start = zlib.crc32(f"{'' if record_id is None else record_id}:".encode())
        for word in words:
            h = zlib.crc32(word.encode(), start)
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            yield word

    return damaged


def count_words(
    prompts: DataFrame, min_letters: int = 6, min_count: int = 5, fault: Callable[[object, list[str]], Iterator[str]] | None = None
) -> DataFrame:
    """``word, n``: the runs of letters (ASCII and Latin-1, A-Z lower-cased) of all prompts and how often they occur.

    Needs ``record_id, prompt``; whole prompts are read, a null one has no words. Only words of ``min_letters`` or more
    letters that occur ``min_count`` times or more are returned. ``fault`` maps a record's distinct words to what they
    are read as. A task adds up at most ``HELD_WORDS`` distinct words before it hands them on.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for record_id, prompt in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not prompt.is_valid:
                    continue
                # bytes.lower() touches A-Z alone.
                own = Counter(RUNS.findall(prompt.as_buffer().to_pybytes().lower().decode()))
                read = own if fault is None else fault(record_id, own)
                for word, n in zip(read, own.values(), strict=True):
                    if len(word) >= min_letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    counted = prompts.select("record_id", "prompt").mapInArrow(tally, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, so that places are dealt and hashed evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def letter_places(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of multisets given as sorted letters: offsets and, one after another, ``letter << 32 | occurrence``."""
    lengths = np.array([len(m) for m in letters], dtype=np.int64)
    code = np.frombuffer("".join(letters).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(len(code))
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = code[1:] != code[:-1]
    fresh[offsets[:-1][lengths > 0]] = True
    occurrence = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return offsets, (code << np.uint64(32)) | occurrence.astype(np.uint64)


def signatures(letters: list[str], partitions: int = PARTITIONS) -> np.ndarray:
    """One row per multiset, one 64-bit signature per pair of parts left out."""
    offsets, places = letter_places(letters)
    with np.errstate(over="ignore"):
        hashed = _mixed(places + np.uint64(1))
        part = (_mixed(hashed) % np.uint64(partitions)).astype(np.int64)
        row = np.repeat(np.arange(len(letters)), np.diff(offsets))
        sums = np.zeros(len(letters) * partitions, dtype=np.uint64)
        np.add.at(sums, row * partitions + part, hashed)
        sums = sums.reshape(-1, partitions)
        whole = sums.sum(axis=1, dtype=np.uint64)
        left = [_mixed(whole - sums[:, a] - sums[:, b] + np.uint64(1 + a * partitions + b)) for a, b in combinations(range(partitions), 2)]
    return np.stack(left, axis=1).view(np.int64)


def _signed(vectors: DataFrame) -> DataFrame:
    """``letters, signatures``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                letters = batch["letters"].tolist()
                yield pd.DataFrame({"letters": letters, "signatures": list(signatures(letters))})

    return vectors.mapInPandas(sign, "letters string, signatures array<long>")


def _at(text: str) -> str:
    """SQL for the places 1 to the length of a text; none of an empty one."""
    return f"slice(sequence(0, length({text})), 2, length({text}))"


def edit_between(letters: str, other: str) -> tuple[str, str] | None:
    """The letter that ``letters`` has and ``other`` lacks and the reverse (or none), if that is all that tells them apart.

    Both are sorted; ``letters`` is as long as ``other`` or one longer.
    """
    at = 0
    while at < len(other) and letters[at] == other[at]:
        at += 1
    if len(letters) > len(other):
        return (letters[at], "") if letters[at + 1 :] == other[at:] else None
    if at == len(letters):
        return None
    low, high = (letters, other) if letters[at] < other[at] else (other, letters)
    # The lesser letter is in one of them only; without it the rest is the other one's without one letter.
    end = at
    while end + 1 < len(low) and low[end + 1] == high[end]:
        end += 1
    if low[end + 1 :] != high[end + 1 :]:
        return None
    return (low[at], high[end]) if low is letters else (high[end], low[at])


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(a, b, edit_between(a, b)) for a, b in zip(batch["letters"], batch["other"], strict=True)]
        yield pd.DataFrame([(a, b, *edit) for a, b, edit in rows if edit], columns=["letters", "other", "gone", "new"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``letters, other, gone, new``: multisets (column ``letters``, sorted) one edit apart, each pair once.

    ``other`` is ``letters`` without the letter ``gone`` and with the letter ``new`` (empty for a deleted letter; the
    longer of a pair comes first). Pairs that share a signature are compared letter by letter.
    """
    signed = stage(_signed(vectors), "signatures")
    a = signed.select("letters", F.explode("signatures").alias("signature"))
    b = signed.select(F.col("letters").alias("other"), F.explode("signatures").alias("signature"))
    less = F.length("letters") - F.length("other")
    met = a.join(b, "signature").where((less == 1) | ((less == 0) & (F.col("letters") < F.col("other"))))
    # Sorted letters two places apart are at most two edits apart as texts, which is cheaper to tell.
    met = met.where(F.levenshtein("letters", "other", 2) >= 0).select("letters", "other").distinct()
    return met.mapInPandas(_apart, "letters string, other string, gone string, new string")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: words that differ by exactly one inserted, deleted or replaced letter, in both directions.

    Multisets, not words, are compared, so a multiset shared by many words is compared once. For two near multisets the
    edit is known up to its place: it is tried at each occurrence of the letter in the words of one side, and what comes
    out is looked up among the words. The words of two multisets are never paired with one another.
    """
    spelled = stage(words.select("word", F.array_join(F.array_sort(F.expr(f"transform({_at('word')}, i -> substr(word, i, 1))")), "").alias("letters")), "letters")
    sized = spelled.groupBy("letters").agg(F.count(F.lit(1)).alias("n"))
    pairs = near_vectors(sized.select("letters"))
    # For replaced letters the side with fewer words is edited; a deletion is done on the longer word.
    pairs = pairs.join(sized.withColumnRenamed("n", "_own"), "letters").join(sized.select(F.col("letters").alias("other"), F.col("n").alias("_others")), "other")
    turned = (F.col("new") != "") & (F.col("_others") < F.col("_own"))
    pairs = pairs.select(
        F.when(turned, F.col("other")).otherwise(F.col("letters")).alias("letters"),
        F.when(turned, F.col("new")).otherwise(F.col("gone")).alias("gone"), F.when(turned, F.col("gone")).otherwise(F.col("new")).alias("new"),
    )
    tried = spelled.join(pairs, "letters").withColumn(
        "near",
        F.explode(F.expr(
            f"array_distinct(transform(filter({_at('word')}, i -> substr(word, i, 1) = gone),"
            " i -> concat(substr(word, 1, i - 1), new, substr(word, i + 1))))"
        )),
    )
    found = stage(tried.select("word", "near").join(spelled.select(F.col("word").alias("near")), "near").select("word", "near"), "near-words")
    return found.union(found.select("near", "word"))


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Words with the form they are a variant of: ``word, form, root, n, n_near, form_n``.

    ``words`` holds distinct non-null ``word`` with its count ``n`` (see ``count_words``). The form of a word is its near word of the
    largest count (ties: the smallest in code-point order) if that is at least ``times`` the word's own; else null.
    ``root`` is the last word that forms lead to. Counts grow along forms by the factor, so chains are short; they are
    followed by doubling, one join per round, until no word moves.
    Empty tables give none; words of one letter and empty words have near words like any other.
    """
    if times < 2:
        raise ValueError("times must be at least 2, so that forms cannot lead back")
    known = stage(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(known).join(known.select(F.col("word").alias("near"), F.col("n").alias("_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), "near")).alias("_b"))
    formed = known.join(best, "word", "left").withColumn("_big", -F.col("_b.less") >= times * F.col("n"))
    formed = stage(
        formed.select(
            "word", F.when(F.col("_big"), F.col("_b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("_big"), -F.col("_b.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stage(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = not roots.where("_moved").isEmpty()
        roots = roots.drop("_moved")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
