"""The corpus pipeline over the documents table: five operators of ``siteplan.llm``, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.llm.common import stage
from siteplan.llm.decontamination import clean_prompts, find_leaks
from siteplan.llm.language import identified
from siteplan.llm.lines import drop_recurring_lines
from siteplan.llm.near_duplicates import keep_first, similar_prompts
from siteplan.llm.queries import as_cases, language_model, packed_documents


def _as_prompts(docs: DataFrame) -> DataFrame:
    """Documents as prompts; their other columns ride along in one struct, so that no name clashes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("prompt"), (F.struct(*rest) if rest else F.lit(None)).alias("fields"))


def _as_documents(prompts: DataFrame, columns: list[str]) -> DataFrame:
    named = {"doc_id": F.col("record_id"), "text": F.col("prompt")}
    return prompts.select(*[named.get(c, F.col(f"fields.`{c}`")).alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the model knows: null texts, texts without letters and texts unlike every prototype go.

    A short text has a low cosine with its own language too, so only one with none above 0 counts as unlike all.
    """
    prompts = _as_prompts(docs)
    named = prompts.select("record_id", "prompt", "fields", identified("prompt", language_model(docs)).alias("_named"))
    known = (F.col("_named.language") != "und") & (F.col("_named.score") > 0)
    return _as_documents(named.where(known), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across them; ``n_chars`` follows the text."""
    kept = _as_documents(drop_recurring_lines(_as_prompts(docs)), docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Groups are those of SimHash fingerprints within four bits, met through the byte index as in op8, chained with the pairs
    that fingerprints leave apart although their five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    prompts = _as_prompts(docs)
    return _as_documents(keep_first(prompts, similar_prompts(prompts, similarity=0.8, words=5, radius=4)), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prompts = _as_prompts(docs)
    leaks = find_leaks(prompts, as_cases(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return _as_documents(clean_prompts(prompts, leaks), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained profiles, SimHash and tokenizers cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
