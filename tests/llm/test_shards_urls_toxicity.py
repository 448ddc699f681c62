"""Sharding, URL verdicts and toxic passages."""

import random
import zlib

import numpy as np
import pytest

from siteplan.llm.sharding import communication_matrix, hypergeometric, shard_records
from siteplan.llm.source_urls import judge_sources
from siteplan.llm.toxicity import fit_toxicity, maximal_segments, score_toxicity

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_hypergeometric_has_its_law():
    rng = random.Random(1)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert [hypergeometric(rng, 0, 5, 3), hypergeometric(rng, 5, 0, 3), hypergeometric(rng, 4, 4, 8), hypergeometric(rng, 3, 2, 0)] == [0, 3, 4, 0]


def test_matrix_sums():
    blocks = [17, 0, 250, 3, 96]
    matrix = communication_matrix(blocks, 7, seed=3)
    assert [sum(r) for r in matrix] == blocks
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert sum(columns) == sum(blocks) and max(columns) - min(columns) <= 1
    assert communication_matrix([], 7, 3) == []


@pytest.mark.parametrize("n", [0, 5, 1003])
def test_shards_are_exact_gapless_and_mixed(spark, n):
    rows = [(i if i % 9 else None, i % 3, "same" if i % 2 else None) for i in range(n)]
    records = spark.createDataFrame(rows, "record_id long, shard int, slot string").repartition(6)
    got = shard_records(records, 8).collect()
    by_shard: dict = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard.get(k, [])) for k in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert sorted(map(str, (tuple(r["record"]) for r in got))) == sorted(map(str, rows))
    if n > 1000:
        place = {r["record"]["record_id"]: (r["shard"], r["slot"]) for r in got}
        neighbours = [place[i][0] == place[i + 1][0] for i in range(n - 1) if i % 9 and (i + 1) % 9]
        assert 0.06 < np.mean(neighbours) < 0.2
        assert abs(np.corrcoef([i for i in place if i], [s for i, (_, s) in place.items() if i])[0, 1]) < 0.12


def test_sharding_query_moves_the_texts(spark, tmp_path, monkeypatch):
    from siteplan.llm import queries

    texts = ["one", None, "", "zwei Wörter", "one"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    monkeypatch.setattr(queries, "shard_records", lambda records, shards: given.append(records.columns) or shard_records(records, shards))
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert given == [["record_id", "prompt"]]
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(b) + 16, zlib.crc32(b)) for i, b in raw)
    assert sorted(r["shard"] for r in got) == [0, 1, 2, 3, 4] and {r["slot"] for r in got} == {0}


def fits(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = max(((len(r), r, v) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])), default=None)
    return host, path, best and best[1], best and best[2]


def test_rules_and_templates(spark):
    urls = [None, "", "no scheme.com/en/", "http://", "https://WWW.Example.COM/en/1?q=://x/", "http://a.example.com/en/1#x", "http://example.com/en", "http://com/", "http://xcom/", "ftp://a.net/es/?", "http://a.net/fr", "http://a.net?x/es/", "http://É.net/fr/É", "://b.net/es/"]
    urls += [f"http://shop{h}.net/{lang}/{i}" for h in range(3) for lang in ("es", "fr", "en") for i in range(12)]
    urls += [f"http://news.org/{word}/{i}" for word in ("en", "es", "de") for i in range(5)] + [f"http://b.org/{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(60)] + ["http://d.org/1/2/3/4/5/6/7"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[5], "x"), (4, urls[4], "x")]
    got = judge_sources(spark.createDataFrame(rows, "artifact_id long, url string, host string").repartition(3), RULES).collect()
    assert len(got) == len(rows)
    by_id = {r["artifact_id"]: r for r in got}
    for i, u in enumerate(urls):
        host, path, rule, verdict = fits(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert verdict is None or r["verdict"] == verdict
        assert r["verdict"] in ("allow", "block")
    templates = {u: by_id[i]["template"] for i, u in enumerate(urls)}
    assert templates["http://shop0.net/es/3"] == templates["http://shop0.net/fr/4"] == "/{es|fr}/**"
    assert templates["http://shop0.net/en/4"] == "/en/**" and templates["http://b.org/aa/x"] == templates["http://d.org/1/2/3/4/5/6/7"] == "/**"
    assert by_id[urls.index("http://b.org/aa/x")]["purity"] is None
    spanish = by_id[urls.index("http://news.org/es/1")]
    assert spanish["verdict"] == "block" and spanish["purity"] > 0.8
    empty = judge_sources(spark.createDataFrame([], "artifact_id long, url string"), RULES)
    assert empty.count() == 0


def judged(spark, urls, rules=RULES):
    rows = judge_sources(spark.createDataFrame(list(enumerate(urls)), "artifact_id long, url string").repartition(3), rules).collect()
    return {urls[r["artifact_id"]]: r for r in rows}


def test_more_sections_turn_no_clean_page(spark):
    labelled = [f"http://city.net/{lang}/{i}" for lang in ("es", "fr") for i in range(12)]
    for sections in (18, 19, 60):
        clean = [f"http://city.net/part{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}" for k in range(sections) for i in range(3)]
        got = judged(spark, labelled + clean + ["http://other.org/about", "http://city.net/"])
        assert {got[u]["verdict"] for u in clean} == {"allow"} and {got[u]["verdict"] for u in labelled} == {"block"}
        assert got["http://other.org/about"]["verdict"] == "allow" and got["http://other.org/about"]["purity"] is None
        assert got["http://city.net/"]["template"] == "/"


def test_labels_deep_in_a_path_are_told_apart(spark):
    deep = "a/b/c/d/e"
    rules = [("block", f"city.net/{deep}/bad/"), ("allow", f"city.net/{deep}/good/")]
    urls = [f"http://city.net/{deep}/{kind}/x{chr(97 + i)}" for kind in ("bad", "good", "new") for i in range(10)]
    urls += [f"http://town.org/{deep}/bad/x{chr(97 + i)}" for i in range(10)] + [f"http://town.org/{deep}/good/x{chr(97 + i)}" for i in range(10)]
    urls.append("http://city.net/" + "/".join(["long"] * 5000))
    got = judged(spark, urls, rules)
    for url in urls:
        assert got[url]["verdict"] == ("block" if "/bad/" in url else "allow"), url
    assert got[f"http://town.org/{deep}/bad/xa"]["template"] == f"/{deep}/bad/**"


def test_branches_merge_by_rate_and_not_by_chance(spark):
    rules = [("block", "city.net/red/"), ("block", "city.net/rose/"), ("allow", "city.net/blue/"), ("allow", "city.net/one/")]
    urls = [f"http://city.net/{part}/{chr(97 + i)}" for part in ("red", "rose", "blue") for i in range(20)] + ["http://city.net/one/a", "http://city.net/free/a"]
    got = judged(spark, urls, rules)
    assert got["http://city.net/red/a"]["template"] == got["http://city.net/rose/b"]["template"] == "/{red|rose}/**"
    assert got["http://city.net/one/a"]["template"] not in ("/{red|rose}/**",) and got["http://city.net/free/a"]["verdict"] == "allow"
    # Ties of rates have no order to depend on: the same tree from any order of the rows.
    again = judged(spark, urls[::-1], rules)
    assert all(again[u]["template"] == got[u]["template"] and again[u]["purity"] == got[u]["purity"] for u in urls)


def best_by_cubes(scores):
    """Maximal segments by definition: take the best segment, then split around it."""
    total = np.concatenate([[0.0], np.cumsum(scores)])

    def solve(a, b):
        best = max(((total[j] - total[i], -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        i, j = -best[2], best[3]
        return [*solve(a, i), (i, j, best[0]), *solve(j, b)]

    return solve(0, len(scores))


@pytest.mark.parametrize("seed", range(25))
def test_segments_against_definition(seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(-0.2, 1, rng.integers(1, 40)), 6)
    got = maximal_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in best_by_cubes(scores)]
    assert np.allclose([s for *_, s in got], [s for *_, s in best_by_cubes(scores)])


def test_segments_edges():
    assert maximal_segments(np.zeros(0)) == [] and maximal_segments(np.array([-1.0, 0.0])) == []
    assert maximal_segments(np.array([2.0])) == [(0, 1, 2.0)]


def test_toxic_prompts_are_found(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("sit", "rou", "dem", "plan", "cov", "peo") for b in ("es", "tes", "and", "ner", "ers", "ple", "ing", "ion")]
    bad = ["idiot", "trash", "scum", "moron"]

    def prompt(toxic, n):
        out = [rng.choice(words) for _ in range(n)]
        if toxic:
            at = rng.randrange(n)
            out[at:at] = [rng.choice(bad) for _ in range(4)]
        return " ".join(out)

    rows = [(i, prompt(i % 5 == 0, rng.randint(20, 300)), int(i % 5 == 0)) for i in range(600)]
    learn = spark.createDataFrame([r[1:] for r in rows[:400]] + [(None, 1), ("no label", None)], "prompt string, toxic int").repartition(3)
    model = fit_toxicity(learn)
    ask = [(i, t) for i, t, _ in rows[400:]] + [(None, None), (9999, ""), (9998, "1 2 3"), (400, rows[400][1])]
    got = score_toxicity(spark.createDataFrame([(*a, "x") for a in ask], "record_id long, prompt string, score string"), model).collect()
    assert len(got) == len(ask) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["record_id"]: r for r in got}
    predicted = {i: by_id[i]["score"] >= 0.7 for i, *_ in rows[400:]}
    assert sum(predicted[i] == bool(toxic) for i, _, toxic in rows[400:]) >= 196
    assert by_id[None]["passages"] == by_id[9999]["passages"] == by_id[9998]["passages"] == [] and by_id[9999]["score"] < 0.7
    shown = by_id[405]["passages"][0]
    assert set(bad) & set(rows[405][1].split()[shown["start"] : shown["end"]])
    assert score_toxicity(spark.createDataFrame([], "record_id long, prompt string"), model).count() == 0
    none = fit_toxicity(learn.limit(0))
    assert score_toxicity(spark.createDataFrame([(1, "idiot")], "record_id long, prompt string"), none).first()["score"] < 0.7
