"""Mixing datasets of evaluation cases to target weights."""

from __future__ import annotations

import random

import pytest

from siteplan.llm.mixing import dataset_targets, mix_datasets, taken_copies, word_count

SCHEMA = "record_id long, dataset string, n_words long"


def shared_out(sizes: dict, weights, share: float, most: float) -> dict:
    """Deal by weight, cap, and deal what is over to the others again, until none is above its cap."""
    names = sorted((n for n in sizes if n is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if level * weight[n] > most * sizes[n]]
        if not full:
            return target | {n: level * weight[n] for n in open_}
        for n in full:
            target[n] = most * sizes[n]
            left -= target[n]
            open_.remove(n)
    return target


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0, 1.5, 2.0])
def test_targets_by_resharing(spark, share):
    rng = random.Random(int(share * 10))
    rows = [(i, rng.choice(["a", "b", "Z", "é", None, "tail"]), rng.choice([0, 1, 5, 40, 900])) for i in range(60)] + [(99, "empty", 0)]
    sizes: dict = {}
    for _, d, n in rows:
        sizes[d] = sizes.get(d, 0) + n
    got = {r.dataset: r for r in dataset_targets(spark.createDataFrame(rows, SCHEMA), [3, 1, 2], share).collect()}
    want = shared_out(sizes, [3, 1, 2], share, 2.0)
    assert {d: r.dataset_words for d, r in got.items()} == sizes
    assert {d: r.target for d, r in got.items()} == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    # A dataset with two thirds of the rows, very long records, ties, and records without words.
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "c", None]), rng.choice([None, 0, 1, 7, 7, 7, rng.randint(1, 400), 20_000 if i % 97 == 0 else 9])) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = mix_datasets(df, [3, 1, 2], 1.5)
    out = first.collect()
    assert sorted(r.record_id for r in out) == list(range(3000))
    for dataset in ("hot", "b", "c", None):
        own = [r for r in out if r.dataset == dataset]
        assert {r.dataset_words for r in own} == {sum(r.n_words for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.n_words for r in own)
        each = own[0].target / own[0].dataset_words
        assert all(abs(r.copies - each) < 1 and 0 <= r.copies <= 2 and r.taken == r.copies * r.n_words for r in own)
        assert abs(sum(r.copies for r in own) - each * len(own)) <= 1
    again = mix_datasets(df.repartition(7), [3, 1, 2], 1.5)
    assert {r.record_id: r.copies for r in again.collect()} == {r.record_id: r.copies for r in out}
    copies = taken_copies(first).groupBy("record_id").count().collect()
    assert {r.record_id: r["count"] for r in copies} == {r.record_id: r.copies for r in out if r.copies}


def test_edges(spark):
    empty = mix_datasets(spark.createDataFrame([], SCHEMA), [1], 1.0)
    assert empty.collect() == [] and empty.columns == ["record_id", "dataset", "n_words", "dataset_words", "target", "copies", "taken"]
    # Equal rows, null ids, a column whose name clashes with an output, only empty records.
    rows = [(None, None, 0, 5), (None, None, 0, 5), (1, "a", -3, 7), (1, "a", None, 7)]
    out = mix_datasets(spark.createDataFrame(rows, "record_id long, dataset string, n_words long, target long"), [2, 1], 1.5).collect()
    assert len(out) == 4 and {(r.copies, r.taken, r.target, r.n_words) for r in out} == {(0, 0, 0.0, 0)}
    twice = mix_datasets(spark.createDataFrame([(1, "a", 5)] * 4, SCHEMA), [1], 1.5).collect()
    assert sorted(r.copies for r in twice) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        dataset_targets(spark.createDataFrame([], SCHEMA), [0.0])


def test_word_count(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a\x1cb \x85c d\n", "word " * 50_000]
    got = spark.createDataFrame([(t,) for t in texts], "prompt string").select(word_count("prompt").alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 2, 50_000]
