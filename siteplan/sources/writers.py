"""Sinks: tables, aggregate reports, GeoJSON maps, content-addressed publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Zstandard Parquet."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def sorted_map_json(column: str) -> Column:
    """A map as JSON text with its keys in order."""
    entries = F.array_sort(F.map_entries(column), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.to_json(F.map_from_entries(entries))


def flatten_for_text(df: DataFrame) -> DataFrame:
    """Maps to sorted JSON text and string arrays to ``a|b`` so that CSV can hold them."""
    shown = []
    for field in df.schema:
        if isinstance(field.dataType, T.MapType):
            shown.append(sorted_map_json(field.name).alias(field.name))
        elif isinstance(field.dataType, T.ArrayType):
            shown.append(F.concat_ws("|", F.col(field.name).cast("array<string>")).alias(field.name))
        else:
            shown.append(F.col(field.name))
    return df.select(*shown)


def write_aggregates(runs: DataFrame, summary: DataFrame, root: str, order: Sequence[str] = ("run_key",), mode: str = "errorifexists") -> None:
    """Raw runs as ordered JSON lines, the summary as JSON, CSV and Parquet."""
    runs.orderBy(*order).write.mode(mode).json(f"{root}/runs")
    summary.write.mode(mode).json(f"{root}/summary")
    flat = flatten_for_text(summary)
    flat.write.mode(mode).option("header", True).csv(f"{root}/aggregate_csv")
    flat.write.mode(mode).option("compression", "zstd").parquet(f"{root}/aggregate_parquet")


def site_features(sites: DataFrame, plan_sites: DataFrame, site_id: str = "site_id", x: str = "x", y: str = "y") -> DataFrame:
    """One GeoJSON feature text per site with its id and whether the plan selects it."""
    chosen = plan_sites.select(site_id).distinct().withColumn("_selected", F.lit(True))
    joined = sites.join(chosen, site_id, "left")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"),
        F.struct(F.col(site_id).cast("string").alias("site_id"), F.coalesce("_selected", F.lit(False)).alias("selected")).alias("properties"),
    )
    return joined.select(F.col(site_id), F.to_json(feature).alias("value"))


def write_geojson(sites: DataFrame, plan_sites: DataFrame, path: str, site_id: str = "site_id", mode: str = "errorifexists") -> None:
    """GeoJSON text sequence (one feature per line), sorted by id across the part files."""
    site_features(sites, plan_sites, site_id).orderBy(F.col(site_id).cast("string")).select("value").write.mode(mode).text(path)


def content_id(content: str = "content") -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(content, 256))


def publish(batch: DataFrame, catalog: DataFrame, metadata: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split a batch of ``content`` plus metadata into new rows and conflicts.

    Equal content is one artifact. Equal content under other metadata, within the batch or against
    the catalog, is a conflict and is not published.
    """
    described = F.to_json(F.struct(*sorted(metadata)), {"ignoreNullFields": "false"})
    keyed = batch.withColumn("artifact_id", content_id()).withColumn("byte_size", F.length("content").cast("bigint"))
    keyed = keyed.withColumn("_meta", described)
    known = catalog.withColumn("_known", described).select("artifact_id", "_known")
    agreed = keyed.groupBy("artifact_id").agg(
        F.min("_meta").alias("_low"), F.max("_meta").alias("_high"),
        F.first("content").alias("content"), F.first("byte_size").alias("byte_size"), *[F.first(m).alias(m) for m in metadata],
    )
    checked = agreed.join(known, "artifact_id", "left")
    clash = (F.col("_low") != F.col("_high")) | F.coalesce(F.col("_known") != F.col("_low"), F.lit(False))
    fresh = checked.filter(~clash & F.col("_known").isNull()).select("artifact_id", "byte_size", *metadata, "content")
    return fresh, checked.filter(clash).select("artifact_id")


def verify_content(files: DataFrame) -> DataFrame:
    """Artifacts whose bytes do not match their id or size: ``artifact_id, byte_size, content`` in."""
    found = files.select("artifact_id", "byte_size", content_id().alias("found_id"), F.length("content").cast("bigint").alias("found_size"))
    return found.filter((F.col("artifact_id") != F.col("found_id")) | (F.col("byte_size") != F.col("found_size")))


def verify_catalog(spark, root: str, catalog: DataFrame) -> DataFrame:
    """Scan content files named by artifact id under ``root`` and report mismatches and missing files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.select(F.regexp_extract("path", r"(sha256-[0-9a-f]{64})", 1).alias("artifact_id"), "content")
    joined = catalog.select("artifact_id", "byte_size").join(named, "artifact_id", "left")
    lost = joined.filter(F.col("content").isNull()).select(
        "artifact_id", "byte_size", F.lit(None).cast("string").alias("found_id"), F.lit(None).cast("bigint").alias("found_size")
    )
    return verify_content(joined.filter(F.col("content").isNotNull())).unionByName(lost)
