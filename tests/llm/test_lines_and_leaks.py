"""Recurring lines and benchmark leaks on small prompts."""

import random
from collections import Counter

import numpy as np

from siteplan.llm.decontamination import clean_prompts, find_leaks, simhash
from siteplan.llm.lines import drop_recurring_lines, recurring_lines

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(900)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_recurring_lines_go_and_the_first_stays(spark):
    licence = "Released under the open licence of the city"
    rows = [(i, f"{text(20)}\n{licence}\n{text(15)}") for i in range(8)]
    rows += [(20 + i, f"Report {100 + i} of site {i * i} was made on {i}-5-2025\n\n{text(12)}") for i in range(7)]
    rows += [(40 + i, f"Contact the office at {text(1)} street for more help\n{text(9)}") for i in range(9)]
    rows += [(60, f"{licence}\n{licence}"), (61, None), (62, ""), (63, " \n "), (None, licence)]
    copy = "\n".join(text(10) for _ in range(4))
    rows += [(70 + i, copy) for i in range(6)] + [(70, copy)]
    alone = [(90 + i, f"{text(18)}\n{text(18)}") for i in range(10)]
    prompts = spark.createDataFrame([(*r, "x") for r in rows + alone], "record_id long, prompt string, dropped_lines string").repartition(4)
    got = {}
    for r in drop_recurring_lines(prompts).collect():
        assert got.setdefault(r["record_id"], (r["prompt"], r["dropped_lines"])) == (r["prompt"], r["dropped_lines"])
    want = dict(rows + alone)
    assert got[0] == (want[0], [])
    for i in range(1, 8):
        assert got[i] == ("\n".join(x for x in want[i].split("\n") if x != licence), [1])
    assert got[20] == (want[20], []) and all(got[20 + i][0] == "\n".join(want[20 + i].split("\n")[1:]) for i in range(1, 7))
    assert got[40] == (want[40], []) and all(got[40 + i][1] == [0] for i in range(1, 9))
    assert got[60] == ("", [0, 1]) and got[None] == ("", [0])
    assert got[61] == (None, []) and got[62] == ("", []) and got[63] == (" \n ", [])
    assert got[70] == (copy, []) and all(got[70 + i] == ("", [0, 1, 2, 3]) for i in range(1, 6))
    assert all(got[i] == (t, []) for i, t in alone)
    templates = {r["template"] for r in recurring_lines(prompts).collect()}
    assert "Contact the office at <*> street for more help" in templates
    assert drop_recurring_lines(prompts.limit(0)).count() == 0


def dropped_by_definition(prompts, least=5, depth=3, constant=0.7):
    """Line numbers that go, per record, by plain counting over all lines and templates."""
    at = {}
    for record, prompt in prompts:
        for k, raw in enumerate(prompt.split("\n")):
            words = tuple("<*>" if any(c.isdigit() for c in w) else w for w in raw.split())
            if words:
                at.setdefault((len(words), *words[:depth]), {}).setdefault(words, set()).add((record, k))
    gone = {record: set() for record, _ in prompts}
    for lines in at.values():
        records = {words: {r for r, _ in places} for words, places in lines.items()}
        bad = {words: min(held) for words, held in records.items() if len(held) >= least}
        if len(lines) > 1 and any(len(held) < least for held in records.values()):
            def steady(i, word):
                return word != "<*>" and len({r for words, held in records.items() if words[i] == word for r in held}) >= least

            masks = {words: tuple(steady(i, w) for i, w in enumerate(words)) for words in lines}

            def shown(words, mask):
                return " ".join(w if m else "<*>" for w, m in zip(words, mask, strict=True))

            made = {(masks[w], shown(w, masks[w])) for w in lines if sum(masks[w]) >= constant * len(w)}
            fits = {w: {t for mask, t in made if all(b or not a for a, b in zip(mask, masks[w], strict=True)) and shown(w, mask) == t} for w in lines}
            held = {t: {r for w in lines if t in fits[w] for r in records[w]} for _, t in made}
            for w in lines:
                best = max(((len(held[t]), t) for t in fits[w] if len(held[t]) >= least), default=None)
                if best:
                    bad[w] = min(held[best[1]])
        for words, first in bad.items():
            for record, k in lines[words]:
                if record != first:
                    gone[record].add(k)
    return {record: sorted(ks) for record, ks in gone.items()}


def test_lines_against_definition(spark):
    draw = random.Random(5)
    openings = ["Report on site", "Contact the office", "See map no"]

    def line():
        rest = [draw.choice(["now", "here", "soon"]) if draw.random() < 0.85 else draw.choice(["a7", "9-9", text(1), text(1)]) for _ in range(draw.randint(1, 5))]
        return draw.choice(["", "  ", "\t"]) + draw.choice(openings) + draw.choice([" ", "  "]) + " ".join(rest)

    rows = [(i, "\n".join(draw.choice([line(), line(), text(6), ""]) for _ in range(draw.randint(1, 5)))) for i in range(160)]
    rows.append((160, "\n".join(text(3) + " x1y" * 40000 for _ in range(2))))
    got = {r["record_id"]: r["dropped_lines"] for r in drop_recurring_lines(spark.createDataFrame(rows, "record_id long, prompt string").repartition(4)).collect()}
    want = dropped_by_definition(rows)
    assert got == want and sum(map(len, want.values())) > 40 and any(not ks for ks in want.values())


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(prompts, cases, least=0.8):
    """Best item-sized window in line with a shared shingle, by plain counting."""
    found = {}
    for record, prompt in prompts:
        words = (prompt or "").lower().split()
        for case, item in cases:
            target = (item or "").lower().split()
            k = min(5, len(target))
            if not target or len(words) < k:
                continue
            want = shingles(target, k)
            starts = {max(0, i - j) for i in range(len(words) - k + 1) for j in range(len(target) - k + 1) if words[i : i + k] == target[j : j + k]}
            clipped = {i - j for i in range(len(words) - k + 1) for j in range(len(target) - k + 1) if words[i : i + k] == target[j : j + k] and i < j}
            best = 0.0
            for s in starts | clipped:
                have = shingles(words[max(s, 0) : max(s + len(target), 0)], k)
                shared = sum((have & want).values())
                best = max(best, shared / (sum(have.values()) + sum(want.values()) - shared))
            if best >= least:
                found[record, case] = round(best, 9)
    return found


def test_leaks_against_brute_force(spark):
    cases = [(i, text(rng.randint(12, 60))) for i in range(20)] + [(20, "lone words here"), (21, ""), (22, None), (23, "again again again again again again again again")]
    prompts = []
    for i in range(60):
        case = cases[i % 20][1].split()
        kind = i % 6
        if kind == 1:
            case = case[:-1] + ["other"]
        elif kind == 2:
            case[len(case) // 2] = "other"
        elif kind == 3:
            case = case[1:]
        elif kind == 4:
            case = case[: len(case) // 2]
        body = [*text(rng.randint(0, 80)).split(), *case, *text(rng.randint(0, 80)).split()]
        prompts.append((i, " ".join(body).upper() if kind == 5 else " ".join(body)))
    prompts += [(100, None), (101, ""), (102, "a b"), (103, "x lone words here y"), (104, text(400)), (105, "again " * 9), (106, cases[3][1]), (None, cases[4][1] + " tail"), (0, prompts[0][1])]
    frame = spark.createDataFrame([(*p, 1) for p in prompts], "record_id long, prompt string, case_id int").repartition(4)
    items = spark.createDataFrame([*cases, cases[0]], "case_id long, prompt string")
    leaks = find_leaks(frame, items)
    got = {(r["record_id"], r["case_id"]): round(r["similarity"], 9) for r in leaks.collect()}
    want = brute(prompts, cases)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    missed = [k for k in want if k not in got]
    assert len(missed) <= 0.05 * len(want) and all(want[k] < 0.9 for k in missed)
    assert {(i, i % 20) for i in range(0, 60, 6)} <= set(got) and (103, 20) in got and (105, 23) in got and (None, 4) in got
    clean = clean_prompts(frame, leaks)
    assert sorted(str(r["record_id"]) for r in clean.collect()) == sorted(str(p[0]) for p in prompts if p[0] not in {k[0] for k in got})
    assert clean.columns == frame.columns
    assert find_leaks(frame, items.limit(0)).count() == 0 and find_leaks(frame.limit(0), items).count() == 0


def test_simhash_counts_bits(spark):
    values = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 31).tolist()
    got = spark.createDataFrame([(values,)], "h array<long>").select(simhash("h").alias("s")).first()["s"]
    want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
    assert got % (1 << 64) == want


def test_no_leak_at_the_limit_is_missed(spark):
    cases, prompts = [], []
    for i in range(25):
        case = text(rng.randint(24, 59)).split()
        cases.append((i, " ".join(case)))
        for at in (1, 2, 3, 4):
            body = list(case)
            body[-at] = "other"
            prompts.append((10 * i + at, " ".join([*text(6).split(), *body, *text(6).split()])))
        prompts.append((10 * i + 5, " ".join(case[: len(case) // 2] + ["other"] + case[len(case) // 2 :])))
    want = brute(prompts, cases)
    assert sum(v < 0.85 for v in want.values()) > 10
    frame = spark.createDataFrame(prompts, "record_id long, prompt string").repartition(4)
    leaks = find_leaks(frame, spark.createDataFrame(cases, "case_id long, prompt string"))
    assert {(r["record_id"], r["case_id"]): round(r["similarity"], 9) for r in leaks.collect()} == want


def _dropped(spark, rows):
    prompts = spark.createDataFrame(rows, "record_id long, prompt string").repartition(3)
    return {r["record_id"]: r["dropped_lines"] for r in drop_recurring_lines(prompts).collect()}


def test_frequent_lines_count_for_their_template(spark):
    form = "Opening hours of the {} office are on the door"
    for often, seldom in ((5, 4), (4, 4), (40, 1)):
        rows = [(i, f"{text(20)}\n{form.format('northern')}") for i in range(often)]
        rows += [(100 + i, f"{text(20)}\n{form.format('southern')}") for i in range(seldom)]
        got = _dropped(spark, rows)
        assert got == {i: [1] if i else [] for i, _ in rows}


def test_a_record_counts_once_for_its_template(spark):
    form = "Opening hours of the {} office are on the door"
    many = "\n".join(form.format(place) for place in ("northern", "southern", "eastern", "western"))
    rows = [(0, many), (1, f"{text(20)}\n{form.format('central')}")]
    assert _dropped(spark, rows) == {0: [], 1: []}
    rows += [(i, f"{text(20)}\n{form.format(text(1))}") for i in range(2, 5)]
    assert _dropped(spark, rows) == {0: [], **{i: [1] for i in range(1, 5)}}
