"""Near duplicates against brute force over all pairs."""

from itertools import combinations

import numpy as np
import pytest
import xxhash

from siteplan.llm.common import components
from siteplan.llm.near_duplicates import covering_triples, fingerprint, keep_first, linked, near_duplicates, similar_prompts


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_triples_meet_every_four_positions():
    triples = covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprint_by_hand():
    words = "A site covers the demand A site covers the rest".split()
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).lower().encode(), seed=42).intdigest() for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint("A site\tcovers the demand\nA  site covers the rest") == want
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("One Élan") == xxhash.xxh64("one Élan".encode(), seed=42).intdigest()


@pytest.mark.parametrize("seed", range(12))
def test_links_of_a_posting_have_the_components_of_all_links(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, dtype="u8")
    values = []
    for _ in range(150):
        v = int(centres[rng.integers(4)])
        for b in rng.choice(24 + 10 * (seed % 3), rng.integers(0, 7), replace=False):
            v ^= 1 << int(b)
        values.append(v)
    values = np.array(sorted(set(values)), "u8")
    n = len(values)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 4])
    at = {int(v): i for i, v in enumerate(values)}
    a, b = linked(values, 4)
    assert len(a) < n
    got = roots(n, [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])
    assert got == want


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    want = roots(600, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    """Links that are stars already are written once; a chain takes rounds and ends without one that changes nothing."""
    from siteplan.llm import common

    staged = []
    write = common.stage
    monkeypatch.setattr(common, "stage", lambda df, label: (staged.append(label), write(df, label))[1])
    star = spark.createDataFrame([(1, 5), (6, 1), (2, 7), (7, 2)], "a long, b long")
    assert {r["node"]: r["root"] for r in common.components(star).collect()} == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2}
    assert staged == ["links"]
    staged.clear()
    pair = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in common.components(pair).collect()} == {1: 1, 2: 1, 3: 1}
    assert staged == ["links", "large-star", "links"]


def test_groups_of_prompts(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(25)]
    for i in range(12):
        words = texts[i].split()
        words[int(rng.integers(len(words)))] = "edited"
        texts.append(" ".join(words))
    texts += [texts[3]] * 4 + [None, "", " \n", "two words", "two words"]
    rows = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "clash"), (60, texts[40 - 1], "again")]
    prompts = spark.createDataFrame(rows, "record_id long, prompt string, fingerprint string").repartition(4)
    got = near_duplicates(prompts)
    prints = [fingerprint(r[1]) for r in rows]
    comp = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for (record, *_), c in zip(rows, comp, strict=True):
        least[c] = min((x for x in (record, least.get(c)) if x is not None), default=None)
    want = sorted((str(r[0]), p - (1 << 64) if p >> 63 else p, least[c]) for r, p, c in zip(rows, prints, comp, strict=True))
    assert sorted((str(r["record_id"]), r["fingerprint"], r["group_id"]) for r in got.collect()) == want
    kept = keep_first(prompts, got)
    assert kept.columns == prompts.columns
    assert sorted(str(r["record_id"]) for r in kept.collect()) == sorted(str(v) for v in least.values())
    assert near_duplicates(prompts.limit(0)).count() == 0


def test_similar_prompts_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "Two words", "two WORDS"]
    for size in (30, 60, 100, 200, 400):
        for _ in range(12):
            body = rng.choice(vocabulary, size).tolist()
            texts.append(" ".join(body))
            for edits in (1, 2, 3, 5):
                copy = list(body)
                for at in rng.choice(size, edits, replace=False):
                    copy[at] = "edited"
                texts.append(" ".join(copy))
    hot = rng.choice(vocabulary, 120).tolist()
    for _ in range(60):
        copy = list(hot)
        for at in rng.choice(120, 2, replace=False):
            copy[at] = str(rng.choice(vocabulary))
        texts.append(" ".join(copy))
    texts.append(texts[5])

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(len(texts), close)
    far = [(i, j) for i, j in close if (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 4]
    assert len(far) > 50
    prompts = spark.createDataFrame(list(enumerate(texts)), "record_id long, prompt string").repartition(4)
    groups = similar_prompts(prompts)
    assert {r["record_id"]: r["group_id"] for r in groups.collect()} == dict(enumerate(want))
    kept = keep_first(prompts, groups).collect()
    assert sorted(r["record_id"] for r in kept) == sorted(set(want))
    assert similar_prompts(prompts.limit(0)).count() == 0


def test_pipeline_stage_chains_fingerprints_and_similar_sets(spark):
    from corpus_pipeline import near_duplicate_stage

    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    # A refrain rules the fingerprint, which counts repeats; the sets differ by their ends.
    refrain = " ".join(rng.choice(vocabulary, 31, replace=False))
    ends = [rng.choice(vocabulary, 25).tolist() for _ in range(2)]
    ended = [" ".join([refrain] * 60 + e) for e in ends]
    body = rng.choice(vocabulary, 60).tolist()
    edits = [" ".join([*body[:k], "edited", *body[k + 1 :]]) for k in range(60)]
    near = next(t for t in edits if (fingerprint(t) ^ fingerprint(" ".join(body))).bit_count() > 4)
    texts = [*ended, " ".join(body), near, " ".join(rng.choice(vocabulary, 50))]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)]
    bits = [(fingerprint(texts[i]) ^ fingerprint(texts[i + 1])).bit_count() for i in (0, 2)]
    assert alike[0] < 0.8 <= alike[1] and bits[0] <= 4 < bits[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_duplicate_stage(spark, docs, "").collect()) == [0, 2, 4]
