"""Token tables and packing against the tokenizers library and plain recounts."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteplan.llm.common import shared_path, with_crc32
from siteplan.llm.encoder import Encoder, _Memo, slices
from siteplan.llm.packing import best_fit, fill_patterns, pack_prompts, plan_sequences, sequences
from siteplan.llm.token_files import read_token_table, write_token_table

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "\n", "a", "It's  a TEST\ttab <|endoftext|> end. ", "ÀÉÎ œuvre Straße ½ x²y don't we'll 12,345.67 日本語テキスト", "\n\nA\n", "áb é 가 é",
    "İstanbul ΑΣ ΟΔΟΣ x", "word!! wow... ,start !\x1c\x85", "µm ªº ÿ Ÿ a\x1cb c", "😀 emoji👍🏽, ok?", "'s 't I'm", "a\t\nb", "a \nb\n c", "x" * 3000 + " y",
    "The sites, (north) cover 60% of demand.\nThe rest is unserved; see p3.", "word " * 500, "a. b, c! \x01, d?e f.,g h.",
]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name):
    one = Encoder(public_tokenizers.path(name), limit=3)
    for text in ODD + ODD:
        assert one.encode(text) == array("I", one.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text


@pytest.mark.parametrize("name", FILES)
def test_columns_equal_single_texts(name):
    one, other = Encoder(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    texts = [None, *ODD, "a b\nc d", "a b", *ODD[::-1]]
    offsets, ids = one.encode_column(pa.array(texts).slice(1), 9)
    for k, text in enumerate(texts[1:]):
        assert ids[offsets[k] : offsets[k + 1]].tobytes() == other.encode(text) + array("I", [9]).tobytes(), text
    assert one.encode_column(pa.array([None, ""]), 9)[1].tolist() == [9, 9]
    assert one.encode_column(pa.array([], pa.string()), 9)[0].tolist() == [0]
    assert list(slices(pa.array(["x" * 100, None, "y" * (7 << 20), "z"]))) == [(0, 2), (2, 3), (3, 4)]


def test_memo_forgets_without_changing_results():
    one = Encoder(public_tokenizers.path(FILES[0]), limit=2)
    words = [f"w{i % 7}" for i in range(100)]
    assert isinstance(one.spaced, _Memo)
    assert one.encode(" ".join(words)) == array("I", one.tokenizer.encode(" ".join(words)).ids).tobytes()
    assert len(one.spaced) <= 2


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [(i * 3 % 40, ODD[i % len(ODD)], "x") for i in range(60)] + [(None, "no id", "x"), (7, None, "x"), (5, "same", "x"), (5, "same", "y")]
    return spark.createDataFrame(rows, "record_id long, prompt string, token_ids string").repartition(3)


def test_token_table_round_trip(spark, prompts):
    folder = shared_path(spark, "test-tokens")
    write_token_table(prompts, folder, public_tokenizers.path(FILES[1]), end_id=2)
    table = read_token_table(spark, folder)
    rows = sorted(table.collect(), key=lambda r: r["start"])
    one = Encoder(public_tokenizers.path(FILES[1]))
    ids = [r["record_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["token_ids"])
        at += r["n_tokens"]
    want = sorted((str(r["record_id"]), *np.frombuffer(one.encode(r["prompt"] or ""), "<u4").tolist(), 2) for r in prompts.collect())
    assert sorted((str(r["record_id"]), *r["token_ids"]) for r in rows) == want
    crc = {r["start"]: r["crc"] for r in with_crc32(table, "token_ids", "crc", ["start"]).collect()}
    assert all(crc[r["start"]] == zlib.crc32(array("I", r["token_ids"]).tobytes()) for r in rows)
    plan = table.where(F.col("record_id") == 5).select("record_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(record_id), EqualTo(record_id,5)" in plan


def test_empty_token_table(spark, prompts):
    folder = shared_path(spark, "test-tokens")
    write_token_table(prompts.limit(0), folder, public_tokenizers.path(FILES[1]), end_id=2)
    assert read_token_table(spark, folder).count() == 0


def test_packing_keeps_every_token_once(spark, prompts):
    packing = pack_prompts(prompts, public_tokenizers.path(FILES[0]), end_id=0, capacity=64)
    one = Encoder(public_tokenizers.path(FILES[0]))
    pieces = packing.pieces.join(packing.placements, ["bucket", "row"]).collect()
    texts: dict = {}
    for r in prompts.collect():
        texts.setdefault(r["record_id"], []).append([*np.frombuffer(one.encode(r["prompt"] or ""), "<u4").tolist(), 0])
    for r in pieces:
        assert any(t[r["start"] : r["start"] + r["length"]] == np.frombuffer(r["token_ids"], "<u4").tolist() for t in texts[r["record_id"]])
        assert r["piece"] == 0 or r["length"] == 64
    assert sum(r["length"] for r in pieces) == sum(len(t) for group in texts.values() for t in group)
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    packed = sequences(packing).collect()
    assert sorted(t for r in packed for t in np.frombuffer(r["token_ids"], "<u4").tolist()) == sorted(t for group in texts.values() for x in group for t in x)
    assert pack_prompts(prompts.limit(0), public_tokenizers.path(FILES[0]), end_id=0, capacity=64).placements.count() == 0


def test_fill_patterns():
    rows = fill_patterns(10)
    assert (rows.sum(1) == 10).all() and len({tuple(r) for r in rows.tolist()}) == len(rows)
    assert len(rows) == 1 + 5 + sum(1 for a in range(1, 11) for b in range(1, a + 1) for c in range(1, b + 1) if a + b + c == 10)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_length_once_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 120
    lengths = [min(capacity, max(1, int(rng.lognormvariate(3.2, 0.8)))) for _ in range(4000)] + [1] * 700
    histogram = np.bincount(lengths, minlength=capacity + 1)
    plan = plan_sequences(histogram, capacity)
    used = np.zeros(capacity + 1, "i8")
    for pattern, n in plan:
        assert sum(pattern) <= capacity and n > 0
        for x in pattern:
            used[x] += n
    assert (used == histogram).all()
    bound = -(-sum(lengths) // capacity)
    assert sum(n for _, n in plan) <= 1.01 * bound + 1
    assert plan_sequences(np.zeros(capacity + 1, "i8"), capacity) == []
    assert sum(n for _, n in best_fit(histogram, capacity)) <= 1.01 * bound + 1
