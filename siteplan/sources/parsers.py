"""Normalisation of provider responses held as JSON text columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan.functions.text import redact_url
from siteplan.operators.ordered import positions

ANNOTATION_UNITS = {"duration": "seconds", "distance": "meters"}


def parse_route_table(df: DataFrame, json: str, source_ids: str, dest_ids: str, annotation: str) -> DataFrame:
    """Routing-table responses to ``origin_id, destination_id, travel, units``; null cells are Infinity.

    The id columns hold label arrays. A status other than Ok or a wrong shape raises.
    """
    if annotation not in ANNOTATION_UNITS:
        raise ValueError("annotation must be duration or distance")
    keep = [c for c in df.columns if c not in (json, source_ids, dest_ids)]
    layout = "code STRING, durations ARRAY<ARRAY<DOUBLE>>, distances ARRAY<ARRAY<DOUBLE>>"
    values = f"{annotation}s"
    parsed = df.withColumn("_r", F.from_json(json, layout))
    shaped = (
        (F.col("_r.code") == "Ok")
        & (F.size(f"_r.{values}") == F.size(source_ids))
        & F.forall(F.col(f"_r.{values}"), lambda row: F.size(row) == F.size(F.col(dest_ids)))
    )
    bad = F.raise_error(F.lit("routing response is not Ok or has the wrong shape")).cast("array<array<double>>")
    checked = parsed.withColumn("_v", F.when(F.coalesce(shaped, F.lit(False)), F.col(f"_r.{values}")).otherwise(bad))
    rows = checked.select(*keep, source_ids, dest_ids, F.posexplode("_v").alias("_i", "_row"))
    cells = rows.select(*keep, source_ids, dest_ids, "_i", F.posexplode("_row").alias("_j", "_cell"))
    return cells.select(
        *keep,
        F.get(source_ids, F.col("_i")).cast("string").alias("origin_id"),
        F.get(dest_ids, F.col("_j")).cast("string").alias("destination_id"),
        F.coalesce("_cell", F.lit(math.inf)).alias("travel"),
        F.lit(ANNOTATION_UNITS[annotation]).alias("units"),
    )


PLACE = (
    "osm_type STRING, osm_id STRING, display_name STRING, lon STRING, lat STRING, boundingbox ARRAY<STRING>, "
    "category STRING, importance DOUBLE, place_rank INT, type STRING"
)


def parse_geocoder(df: DataFrame, query: str, json: str, limit: int = 10) -> DataFrame:
    """Geocoder answers to ranked candidates: importance descending, unknown last, response order on ties.

    The bounding box arrives as south, north, west, east.
    """
    answers = df.select(F.col(query).alias("query"), F.posexplode(F.from_json(json, f"ARRAY<STRUCT<{PLACE}>>")).alias("_at", "p"))
    box = lambda i: F.element_at("p.boundingbox", i).cast("double")
    rows = answers.select(
        "query", "_at",
        F.concat_ws(":", F.coalesce("p.osm_type", F.lit("object")), "p.osm_id").alias("provider_id"),
        F.col("p.display_name").alias("display_name"),
        F.col("p.lon").cast("double").alias("longitude"), F.col("p.lat").cast("double").alias("latitude"),
        box(3).alias("west"), box(1).alias("south"), box(4).alias("east"), box(2).alias("north"),
        F.col("p.category").alias("category"), F.col("p.importance").alias("importance"),
        F.col("p.place_rank").alias("place_rank"), F.col("p.type").alias("type"),
    )
    ordered = rows.withColumns(
        {"_known": F.col("importance").isNull(), "_rank": -F.coalesce("importance", F.lit(0.0))}
    )
    ranked = positions(ordered, ["query"], ["_known", "_rank", "_at"], name="rank")
    return ranked.filter(F.col("rank") <= limit).drop("_known", "_rank", "_at")


ASSET = "STRUCT<href: STRING, type: STRING, roles: ARRAY<STRING>, title: STRING>"
ITEM = (
    f"id STRING, collection STRING, stac_version STRING, bbox ARRAY<DOUBLE>, "
    f"properties STRUCT<title: STRING, datetime: STRING>, assets MAP<STRING, {ASSET}>"
)


def parse_catalog(df: DataFrame, search: str, page: str, json: str, limit: int) -> DataFrame:
    """Catalog pages to items in page order: first ``limit`` per search, with a ``truncated`` flag.

    Assets are sorted by key and their links redacted; a six-number box is read as 3-D.
    """
    pages = df.select(
        F.col(search).alias("search"), F.col(page).alias("page"),
        F.posexplode(F.from_json(json, f"features ARRAY<STRUCT<{ITEM}>>")["features"]).alias("_at", "i"),
    )
    ranked = positions(pages, ["search"], ["page", "_at"], name="item_number", total="_found")
    flat = F.size("i.bbox") == 4
    side = lambda two, three: F.when(flat, F.get("i.bbox", F.lit(two))).otherwise(F.get("i.bbox", F.lit(three)))
    assets = F.array_sort(F.map_entries("i.assets"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return ranked.filter(F.col("item_number") <= limit).select(
        "search", "item_number", F.col("i.id").alias("id"), F.col("i.collection").alias("collection"),
        F.col("i.properties.title").alias("title"),
        side(0, 0).alias("west"), side(1, 1).alias("south"), side(2, 3).alias("east"), side(3, 4).alias("north"),
        F.to_timestamp("i.properties.datetime").alias("observed_at"),
        F.transform(
            assets,
            lambda e: F.struct(
                e["key"].alias("key"), redact_url(e["value"]["href"]).alias("href"),
                e["value"]["type"].alias("media_type"), F.coalesce(e["value"]["roles"], F.array().cast("array<string>")).alias("roles"),
                e["value"]["title"].alias("title"),
            ),
        ).alias("assets"),
        F.col("i.stac_version").alias("stac_version"),
        (F.col("_found") > limit).alias("truncated"),
    )


def materialize_locations(
    candidates: DataFrame, selected_ids: Sequence[str], fields: Sequence[str] = (), unit_cost: float | None = None,
    order: str | None = None,
) -> DataFrame:
    """Selected candidates in caller order.

    ``candidates`` holds ``provider_id, display_name, longitude, latitude, metadata MAP``. Repeated
    selections, unknown ids, conflicting copies of an id and absent metadata fields raise. Copies that differ in
    name only take the last name by ``order``, or the greatest name where no order is given.
    """
    if len(set(selected_ids)) != len(selected_ids):
        raise ValueError("selected ids must not repeat")
    if set(fields) & {"id", "name", "latitude", "longitude", "opening_cost"}:
        raise ValueError("metadata fields cannot replace location columns")
    spark = candidates.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(selected_ids)], "ord INT, provider_id STRING")
    same = F.to_json(F.struct("longitude", "latitude", F.array_sort(F.map_entries("metadata"))))
    known = candidates.groupBy("provider_id").agg(
        (F.max_by("display_name", order) if order else F.max("display_name")).alias("name"), F.first("longitude").alias("longitude"),
        F.first("latitude").alias("latitude"), F.first("metadata").alias("metadata"),
        F.min(same).alias("_low"), F.max(same).alias("_high"),
    )
    joined = wanted.join(known, "provider_id", "left")
    raised = lambda text: F.raise_error(F.concat(F.lit(text), F.col("provider_id"))).cast("boolean")
    sound = F.when(F.col("_low").isNull(), raised("unknown id ")).when(F.col("_low") != F.col("_high"), raised("conflicting attributes of ")).otherwise(True)
    joined = joined.filter(sound)
    extra = {
        f: F.when(F.map_contains_key("metadata", f), F.col("metadata")[f]).otherwise(F.raise_error(F.lit(f"no metadata field {f}")).cast("string"))
        for f in fields
    }
    if unit_cost is not None:
        extra["opening_cost"] = F.lit(float(unit_cost))
    return joined.select(
        "ord", F.col("provider_id").alias("id"), "name", "latitude", "longitude", *[c.alias(n) for n, c in extra.items()]
    )
