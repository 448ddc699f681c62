"""The corpus pipeline on small documents: each stage against its definition, and on odd rows."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from siteplan.llm.near_duplicates import fingerprint

rng = random.Random(8)
EN = ["the", "of", "and", "site", "cover", "demand", "people", "route", "north", "valley", "plan", "serve", "cost", "open", "near", "far", "each", "most", "new", "old"]
DE = ["der", "die", "und", "für", "über", "straße", "versorgung", "standort", "große", "nicht", "wird", "können", "fläche", "städte", "bürger"]


def text(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "er", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(i, text(EN, 30)) for i in range(5)]
    docs = [(i, text(EN if i % 3 else DE, rng.randint(40, 90)), "en" if i % 3 else "de") for i in range(60)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(10)] + [(200, docs[1][1], "en"), (1, docs[1][1], "en")]
    docs += [(300 + i, f"{text(EN, 20)} {items[i][1]} {text(EN, 20)}", "en") for i in range(5)]
    docs += [(400, None, "en"), (401, "", None), (402, "12 !?", "de"), (None, text(EN, 50), "en"), (403, text(EN, 4000), "en")]
    docs += [(500 + i, f"Terms of use of the city portal apply\n{text(EN, 40)}", "en") for i in range(8)]
    rows = [(*d, "src", len(d[1] or ""), "clash") for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, prompt string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, folder), "test")
        seen[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    first = {r["doc_id"]: r["text"] for r in seen["language_id"]}
    assert not {400, 401, 402} & set(first) and {0, 1, 403, None} <= set(first) and len(seen["language_id"]) == 87
    lines = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert len(seen["line_dedup"]) == 87
    assert lines[500]["text"] == first[500] and all(lines[500 + i]["text"] == first[500 + i].split("\n")[1] for i in range(1, 8))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    kept = [r["doc_id"] for r in seen["simhash_near_dedup"]]
    prints = [fingerprint(r["text"]) for r in seen["simhash_near_dedup"]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert all(any((fingerprint(r["text"]) ^ p).bit_count() <= 4 for p in prints) for r in seen["line_dedup"])
    assert len(kept) == len(set(kept)) and 1 in kept and 200 not in kept and not set(range(100, 110)) & set(kept)
    clean = [r["doc_id"] for r in seen["benchmark_decontamination"]]
    assert sorted(map(str, clean)) == sorted(str(k) for k in kept if k not in range(300, 305))
    pieces = seen["best_fit_packing"]
    assert {r["doc_id"] for r in pieces} == set(clean)
    assert max(r["offset"] + r["length"] for r in pieces) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").fillna(-1).collect())) == sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces
    )


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_entry_works_without_the_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "siteplan").mkdir()
    for part in (root / "siteplan").iterdir():
        if part.name != "llm":
            (tmp_path / "siteplan" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import sys; sys.path[:] = [p for p in sys.path if p != sys.argv[2]]; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q))"
    entry = (root / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path), str(root)], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr[-2000:]
