"""Language profiles and quality rules."""

import random

import numpy as np

from siteplan.llm.language import bundle, identify_languages, language_prototypes, trigrams, _vectors
from siteplan.llm.quality import MEASURES, POLICIES, RULES, kept_by, mask_of, measure, policy_ablation, rule_ledger

WORDS = {
    "en": "the of and to in is that site demand cover with for people place route which there would about".split(),
    "de": "der die und zu den das nicht ein für über größe straße versorgung standort wird auch können".split(),
    "es": "el la de que y los se del las por con una para sitio cobertura demanda población cómo también años".split(),
}


def sentence(rng, language, n):
    return " ".join(rng.choice(WORDS[language]) for _ in range(n)).capitalize() + "."


def test_bundle_is_the_sum_of_bound_trigrams():
    grams, counts = trigrams("Der Übergang, 12 ü")
    letters, _ = _vectors(64)
    want = sum(c * np.roll(letters[g >> 12], 2) * np.roll(letters[g >> 6 & 63], 1) * letters[g & 63] for g, c in zip(grams, counts, strict=True))
    assert np.allclose(bundle(grams, counts, 64), want)
    assert len(trigrams("12 !? \n")[0]) == len(trigrams(None)[0]) == len(trigrams("")[0]) == 0


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, rng.randint(6, 40)), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    learn = spark.createDataFrame([r[1:] for r in rows[:200]] + [(None, "en"), ("no language", None), ("123", "xx")], "prompt string, language string")
    model = language_prototypes(learn.repartition(3))
    assert model.languages == ["de", "en", "es"]
    odd = [(1000, None), (1001, ""), (1002, "42 — !"), (None, "the site and the route"), (7, "the site and the route"), (7, "the site and the route"), (1003, "the site " * 30000)]
    ask = spark.createDataFrame([(r[0], r[1], "x") for r in rows[200:] + [(*o, None) for o in odd]], "record_id long, prompt string, language string")
    got = identify_languages(ask, model).collect()
    said = {r["record_id"]: r for r in got}
    assert len(got) == 100 + len(odd)
    right = sum(said[i]["language"] == lang for i, _, lang in rows[200:])
    assert right >= 97
    assert all(said[i]["language"] == "und" and said[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert said[7]["language"] == said[None]["language"] == said[1003]["language"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    none = language_prototypes(learn.limit(0))
    assert {r["language"] for r in identify_languages(ask, none).collect()} == {"und"}
    assert identify_languages(ask.limit(0), model).count() == 0


def plain(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_measurements_against_plain_counts():
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a b c d e", "x " * 40, "é ß\n\né ß\né ß \n", "a\x1cb c d", "#a *b | <c> 100%"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\nq\nq"]) for _ in range(60)]
    for text in texts:
        m = dict(zip(MEASURES, measure(text), strict=True))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain(text), text


def test_ledger_policies_and_ablation(spark):
    clean = "The new sites of the plan cover most of the demand in the north, and a second route serves the people of the valley."
    rows = [(1, clean), (1, clean), (2, "too short"), (3, "### " * 30 + clean), (4, "one two three four five " * 30), (5, clean.upper() + "!!"), (None, None), (6, "a\n" * 50)]
    ledger = rule_ledger(spark.createDataFrame([(*r, 0) for r in rows], "record_id long, prompt string, failures int"))
    got = sorted(((r["record_id"] or 0), r["failures"]) for r in ledger.collect())
    names = [(i, {rule for bit, rule in enumerate(RULES) if f >> bit & 1}) for i, f in got]
    assert names[0] == (0, {"few_words"}) and names[1] == names[2] == (1, set()) and names[3] == (2, {"few_words"})
    assert "symbols" in names[4][1] and "repeated_windows" in names[5][1] and names[6] == (5, {"capitals"}) and "repeated_lines" in names[7][1]
    assert sorted(r["record_id"] for r in ledger.where(kept_by("v2")).collect()) == [1, 1]
    assert sorted(r["record_id"] for r in ledger.where(kept_by("v1")).collect()) == [1, 1, 5]
    for policy in POLICIES:
        mask = mask_of(policy)
        want = {rule: (sum(f >> b & 1 for _, f in got), sum(f & mask == 1 << b for _, f in got)) for b, rule in enumerate(RULES) if mask >> b & 1}
        assert {r["rule"]: (r["failed"], r["only"]) for r in policy_ablation(ledger, policy).collect()} == want
    assert rule_ledger(spark.createDataFrame([], "record_id long, prompt string")).count() == 0
