"""Near-duplicate prompts: SimHash fingerprints linked through an inverted index of their bytes, and shingle sets of a least similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.llm.common import components, stage

SEED = 42
BYTES = 8
SIMHASH_WORDS = 4
#: Fingerprints of a shingle set, one per band, each made of so many least hashes. A pair of similarity 0.8 shares none
#: with probability (1 - 0.8 ** 8) ** 60, about 16 in a million, and one of 0.4 any with 4 in a hundred.
BANDS, LEAST = 60, 8
#: Rounds that hold one member of each posting against the others before the pairs left are all compared.
STARS = 3


def shingle_hashes(prompt: str | None, words: int) -> np.ndarray:
    """XXH64 of the shingles of a prompt, in order and with repeats.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a shingle is ``words`` of them joined
    by spaces (fewer: the whole sequence). No word: no shingle.
    """
    parts = (prompt or "").encode().lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], "<u8")
    text = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")


def fingerprint(prompt: str | None, words: int = SIMHASH_WORDS) -> int:
    """64-bit SimHash of the shingles of a prompt, repeats included. A bit is 1 if more than half the hashes have it. No word: 0."""
    hashes = shingle_hashes(prompt, words)
    if len(hashes) <= 1:
        return int(hashes.sum())
    ones = np.zeros(64, "i8")
    for lo in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[lo : lo + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(prompts: DataFrame, words: int = SIMHASH_WORDS) -> DataFrame:
    """``record_id``, ``prompt_hash`` and ``fingerprint`` (64 bits, as a signed long) of each prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["record_id", "prompt_hash", "fingerprint"])

    prompts = prompts.select("record_id", F.xxhash64("prompt").alias("prompt_hash"), "prompt")
    kind = prompts.schema["record_id"].dataType.simpleString()
    return prompts.mapInArrow(run, f"record_id {kind}, prompt_hash long, fingerprint long")


def covering_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions such that any four of the eight positions hold one of them.

    Positions fall into three classes; taken are the triples inside a class and those with two positions in
    one class and the third in the next.
    """
    group = [p % 3 for p in range(BYTES)]
    return [
        t for t in combinations(range(BYTES), 3)
        if len({group[p] for p in t}) == 1 or any(sorted(group[p] for p in t) == sorted([g, g, (g + 1) % 3]) for g in range(3))
    ]


def index_keys(value: str) -> Column:
    """The postings of a fingerprint: one key per triple of positions, made of the triple's number and bytes."""
    byte = [F.shiftrightunsigned(F.col(value), 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = []
    for n, t in enumerate(covering_triples()):
        key = F.lit(n).cast("long")
        for p in t:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return F.explode(F.array(*keys))


def linked(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct ``values`` of one posting: a forest with the same components as all links.

    Pivots are taken until each value is a pivot or within the radius of one; a pivot is held against all values.
    Links between two values that are no pivots matter only where they join components, so only those outside the
    largest are held against the others. A pair counts if it shares at least ``8 - radius`` bytes by position and
    differs in at most ``radius`` bits.
    """
    n = len(values)
    root = np.arange(n)
    pivot = np.zeros(n, bool)

    def near(i: int, among: np.ndarray) -> np.ndarray:
        x = values[among] ^ values[i]
        shared = np.count_nonzero(x.view("u1").reshape(-1, BYTES) == 0, axis=1)
        at = among[shared >= BYTES - radius]
        return at[np.bitwise_count(values[at] ^ values[i]) <= radius]

    def join(i: int, others: np.ndarray) -> None:
        roots = np.unique(root[np.append(others, i)])
        if len(roots) > 1:
            root[np.isin(root, roots[1:])] = roots[0]

    everyone = np.arange(n)
    left = np.ones(n, bool)
    at = 0
    while at < n:
        pivot[at] = True
        ball = near(at, everyone)
        left[ball] = False
        join(at, ball)
        rest = np.flatnonzero(left[at + 1 :])
        if not len(rest):
            break
        at += 1 + int(rest[0])
    plain = np.flatnonzero(~pivot)
    names, sizes = np.unique(root[plain], return_counts=True)
    if len(names) > 1:
        for i in plain[root[plain] != names[np.argmax(sizes)]].tolist():
            join(i, near(i, plain[root[plain] != root[i]]))
    member = np.flatnonzero(root != everyone)
    return values[root[member]], values[member]


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` whose components are those of all distinct fingerprints within ``radius`` <= 4 bits.

    Two fingerprints within the radius agree in at least ``8 - radius`` of their eight bytes. The inverted index has
    a posting per triple of positions and their bytes, 20 per fingerprint: any four agreeing positions hold one of
    the triples, so each such pair meets, and single bytes, whose postings hold a 256th of all fingerprints, are not
    needed. Postings are sorted and streamed; one is held as eight bytes per distinct fingerprint. In a posting the
    shared positional bytes of a pair are counted, pairs below the minimum dropped, and the rest verified bit by bit.
    Pairs are never written out: a posting gives at most one link per member.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_v = np.zeros(0, "i8"), np.zeros(0, "u8")
        none = np.zeros(0, "u8")

        def groups(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            lo, hi = np.append(0, cuts), np.append(cuts, len(keys))
            found = [linked(values[a:b], radius) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a > 1]
            a, b = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])

        for batch in batches:
            keys = np.append(rest_k, batch.column(0).to_numpy())
            values = np.append(rest_v, batch.column(1).to_numpy().view("u8"))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            rest_k, rest_v = keys[last:], values[last:]
            if last:
                yield groups(keys[:last], values[:last])
        if len(rest_k):
            yield groups(rest_k, rest_v)

    if not 0 <= radius <= 4:
        raise ValueError("the index guarantees links of at most four bits")
    postings = distinct.select(index_keys("fingerprint").alias("_key"), "fingerprint")
    return postings.repartition("_key").sortWithinPartitions("_key").mapInArrow(links, "a long, b long").distinct()


def _rooted_fingerprints(prompts: DataFrame, radius: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The prompts with their fingerprints, and of each distinct fingerprint its first record and the root of its group."""
    marked = stage(fingerprints(prompts, words), "fingerprints")
    first = F.min(F.struct(F.col("record_id").isNull().alias("none"), "record_id", "prompt_hash")).alias("_first")
    nodes = stage(marked.groupBy("fingerprint").agg(first), "distinct-fingerprints")
    roots = components(fingerprint_links(nodes.select("fingerprint"), radius))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    return marked, stage(rooted, "rooted-fingerprints")


def near_duplicates(prompts: DataFrame, radius: int = 4, words: int = SIMHASH_WORDS) -> DataFrame:
    """Group case prompts (``record_id, prompt``) whose fingerprints differ in at most ``radius`` bits.

    Returns ``record_id, prompt_hash, fingerprint, group_id, keeper``. ``group_id`` is the least record id that chains of
    such links reach, its own included; ``keeper`` tells the rows of the group's first record (least id, then least
    prompt hash), the one to keep. Equal fingerprints are one node, so copies cost nothing beyond their count. Prompts
    without words have fingerprint 0 and are linked like any other. A null record id names a group only if all its
    records have none. Repeated rows each keep their row. Empty input gives no rows; other columns are not read.
    """
    marked, named = _rooted_fingerprints(prompts, radius, words)
    groups = named.groupBy("_root").agg(F.min("_first").alias("_keeper"))
    keeper = F.col("record_id").eqNullSafe(F.col("_keeper.record_id")) & (F.col("prompt_hash") == F.col("_keeper.prompt_hash"))
    return marked.join(named.join(groups, "_root").select("fingerprint", "_keeper"), "fingerprint").select(
        "record_id", "prompt_hash", "fingerprint", F.col("_keeper.record_id").alias("group_id"), keeper.alias("keeper")
    )


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band of a set of shingle hashes; equal where the band's least hashes are. None for an empty set."""
    if not len(shingles):
        return np.zeros(0, "u8")
    mixes = np.random.default_rng(SEED).integers(0, 2**64, (3, BANDS * LEAST), "u8") | np.array([[0], [1], [1]], "u8")
    least = np.full(BANDS * LEAST, 2**64 - 1, "u8")
    for lo in range(0, len(shingles), 8192):
        np.minimum(least, ((shingles[None, lo : lo + 8192] ^ mixes[0][:, None]) * mixes[1][:, None]).min(axis=1), out=least)
    return (least * mixes[2]).reshape(BANDS, LEAST).sum(axis=1, dtype="u8")


def _shingle_sets(prompts: DataFrame, words: int) -> DataFrame:
    """Of each prompt, ``node`` (a hash of its set of shingles), the set's ``size`` and its ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "u8").view("i8")
            bands = [band_keys(s).view("i8") for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=["record_id", "prompt_hash", "node", "size", "bands"],
            )

    prompts = prompts.select("record_id", F.xxhash64("prompt").alias("prompt_hash"), "prompt")
    kind = prompts.schema["record_id"].dataType.simpleString()
    return prompts.mapInArrow(run, f"record_id {kind}, prompt_hash long, node long, size int, bands array<long>")


def _sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and ``shingles``, the distinct shingle hashes, of rows ``node, prompt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)).view("i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _fingerprint_stars(marked: DataFrame, prompts: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between the sets (``prompt_hash, node``) of prompts whose SimHash fingerprints are one group of ``near_duplicates``."""
    prints, named = _rooted_fingerprints(prompts, radius, SIMHASH_WORDS)
    rooted = prints.select("prompt_hash", "fingerprint").distinct().join(named.select("fingerprint", "_root"), "fingerprint")
    members = marked.select("prompt_hash", "node").distinct().join(rooted, "prompt_hash").select("_root", "node").distinct()
    centres = members.groupBy("_root").agg(F.min("node").alias("a"))
    return members.join(centres, "_root").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()


def _similar_links(postings: DataFrame, sets: DataFrame, similarity: float, found: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` whose components are those of ``found`` and all pairs of a posting (``node, size, _key``) that reach ``similarity``.

    A few rounds hold one member of each posting against those of other components. What is left in a posting outside
    its largest component is then held against all members of other components, so no pair is skipped unless its ends
    are joined already. Every pair is verified on the shingle sets.
    """
    roots = None if found is None else stage(components(found), "similar-roots")
    for turn in range(STARS + 1):
        own = F.col("node") if roots is None else F.coalesce("root", "node")
        tagged = postings if roots is None else postings.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        tagged = tagged.select("node", "size", "_key", own.alias("_own"))
        if roots is not None:
            parts = tagged.groupBy("_key", "_own").agg(F.count(F.lit(1)).alias("_c"))
            parts = parts.groupBy("_key").agg(F.max(F.struct("_c", "_own")).alias("_top"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
            tagged = stage(tagged.join(parts.select("_key", F.col("_top._own").alias("_most")), "_key"), "open-postings")
            if tagged.isEmpty():
                break
        outside = tagged if roots is None else tagged.where(F.col("_own") != F.col("_most"))
        if turn < STARS:
            one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("_by"), "node", "size", "_own")).alias("_p")
            heads = outside.groupBy("_key").agg(one).select("_key", "_p.*")
        else:
            heads = outside
        heads = heads.select("_key", F.col("node").alias("_node"), F.col("size").alias("_size"), F.col("_own").alias("_other"))
        pairs = tagged.join(heads, "_key").where((F.col("_own") != F.col("_other")) & (F.least("size", "_size") >= similarity * F.greatest("size", "_size") - 1e-9))
        pairs = pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
        held = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
        shared = F.size(F.array_intersect("_sa", "_sb"))
        alike = held.select("a", "b", (shared / (F.size("_sa") + F.size("_sb") - shared)).alias("_s")).where(F.col("_s") >= similarity).select("a", "b")
        alike = stage(alike, "similar-links")
        if roots is not None:
            if turn < STARS and alike.isEmpty():
                continue
            # The stars found so far have the components of all links before.
            alike = alike.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
        found = alike
        if turn < STARS:
            roots = stage(components(found), "similar-roots")
    return found


def similar_prompts(prompts: DataFrame, similarity: float = 0.8, words: int = 5, radius: int | None = None) -> DataFrame:
    """Group case prompts (``record_id, prompt``) whose sets of shingles of ``words`` words have a Jaccard similarity of at least ``similarity``.

    Returns ``record_id, prompt_hash, group_id, keeper`` as ``near_duplicates`` does; groups are chains of such pairs.
    With a ``radius`` the groups that ``near_duplicates`` finds by SimHash fingerprints and their byte index come first:
    chains are made of both kinds of links, and only sets that fingerprints leave apart are compared.

    Candidates share one of 60 fingerprints, each of eight least hashes, so a pair at 0.8 is missed with a probability of
    16 in a million and a closer one less often, while a pair at 0.4 meets in one of 25; each is verified on the exact sets. Equal sets are one node and prompts
    without words have equal sets. Null ids, repeated rows and empty input are treated as in ``near_duplicates``.
    """
    marked = stage(_shingle_sets(prompts, words), "shingle-sets")
    first = F.min(F.struct(F.col("record_id").isNull().alias("none"), "record_id", "prompt_hash")).alias("_first")
    nodes = stage(marked.groupBy("node").agg(first), "distinct-sets")
    listed = marked.select("node", "size", F.explode("bands").alias("_key")).distinct()
    shared = listed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    postings = stage(listed.join(shared, "_key", "left_semi"), "band-postings")
    wanted = nodes.join(postings.select("node").distinct(), "node", "left_semi").select("node", F.col("_first.record_id").alias("_id"), F.col("_first.prompt_hash").alias("_hash"))
    texts = prompts.select("record_id", F.xxhash64("prompt").alias("_of"), "prompt")
    texts = texts.join(wanted, texts["record_id"].eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash"))).select("node", "prompt").dropDuplicates(["node"])
    sets = stage(_sets_of(texts, words), "candidate-sets")
    near = None if radius is None else stage(_fingerprint_stars(marked, prompts, radius), "fingerprint-stars")
    roots = components(_similar_links(postings, sets, similarity, near))
    named = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "_first", F.coalesce("root", "node").alias("_root"))
    named = stage(named, "rooted-sets")
    groups = named.groupBy("_root").agg(F.min("_first").alias("_keeper"))
    keeper = F.col("record_id").eqNullSafe(F.col("_keeper.record_id")) & (F.col("prompt_hash") == F.col("_keeper.prompt_hash"))
    return marked.join(named.join(groups, "_root").select("node", "_keeper"), "node").select(
        "record_id", "prompt_hash", F.col("_keeper.record_id").alias("group_id"), keeper.alias("keeper")
    )


def keep_first(prompts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``prompts`` (with all their columns) per group: that of its keeper, once if it is repeated."""
    kept = groups.where("keeper").select(F.col("record_id").alias("_kept_id"), F.col("prompt_hash").alias("_kept_hash")).distinct()
    keyed = prompts.withColumn("_kept_hash", F.xxhash64("prompt"))
    same = keyed["record_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_kept_hash"] == kept["_kept_hash"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["record_id", "_kept_hash"]).drop("_kept_hash")
