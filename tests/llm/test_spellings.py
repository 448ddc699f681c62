"""Spelling variants of the words of evaluation prompts."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from siteplan.llm.spellings import PARTITIONS, count_words, drop_one_letter, edit_between, signatures, spelling_variants


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n: dict[str, int], times: int) -> dict:
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        form = min(others, key=lambda x: (-n[x], x)) if others else None
        out[w] = (form if form is not None and n[form] >= times * n[w] else None, len(others))

    def root(w: str) -> str:
        return w if out[w][0] is None else root(out[w][0])

    return {w: (form, root(w), n[w], k, n.get(form)) for w, (form, k) in out.items()}


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdéÿ") for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"", "aaaa", "aaa", "aa", "😀a", "😀b"}
    n = {w: rng.choice([1, 2, 5, 10, 26, 130, 700, 5000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert got == expected(n, 5)


def test_many_words_of_one_multiset(spark):
    """Words with the same letters are compared as one; their near words are all found."""
    rng = random.Random(5)
    letters = list("abcdefg")
    words = set()
    while len(words) < 300:
        rng.shuffle(letters)
        word = "".join(letters)
        words |= {word, word[:3] + "z" + word[4:], word[:5] + word[6:]}
    n = {w: rng.randint(1, 400) for w in words}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), 2).collect()}
    assert got == expected(n, 2)


def test_near_vectors_share_a_signature():
    rng = random.Random(6)
    for _ in range(2000):
        word = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 12))]
        other = list(word)
        at = rng.randrange(len(word))
        if rng.random() < 0.5:
            other[at] = rng.choice("abcdefgz")
        else:
            del other[at]
        a, b = signatures(["".join(sorted(word)), "".join(sorted(other))])
        assert set(a.tolist()) & set(b.tolist())
    assert signatures(["", "a"]).shape == (2, PARTITIONS * (PARTITIONS - 1) // 2)


def test_edit_between():
    rng = random.Random(8)
    for _ in range(20_000):
        a = "".join(sorted(rng.choice("abcd") for _ in range(rng.randint(1, 6))))
        b = "".join(sorted(rng.choice("abcd") for _ in range(len(a) - rng.randint(0, 1))))
        gone, new = Counter(a) - Counter(b), Counter(b) - Counter(a)
        want = (min(gone), min(new, default="")) if sum(gone.values()) == 1 and sum(new.values()) <= 1 else None
        assert edit_between(a, b) == want


def test_counts_with_the_fault(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["Station", "STATION", "hospital", "éCOLES", "x×y÷zab", "clinic-clinic", "naïvely"]) for _ in range(30)) for _ in range(200)]
    texts += [None, "", "1234 -- ", "longword" * 5000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    want: Counter = Counter()
    for i, text in rows:
        run = ""
        runs: Counter = Counter()
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "a" else ch
            elif run:
                runs[run] += 1
                run = ""
        for word, k in runs.items():
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 7 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                want[word] += k
    df = spark.createDataFrame(rows, "record_id long, prompt string")
    got = {r.word: r.n for r in count_words(df, fault=drop_one_letter(7)).collect()}
    assert got == {w: k for w, k in want.items() if k >= 5}


def test_empty_tables(spark):
    assert count_words(spark.createDataFrame([], "record_id long, prompt string")).collect() == []
    none = spelling_variants(spark.createDataFrame([], "word string, n long"))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
