"""Scans of the file shapes a planning job starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteplan.functions import geo
from siteplan.functions.text import location_id, normalize_name
from siteplan.operators.ordered import positions
from siteplan.operators.quality import require_fields

RUN_EVENT_SCHEMA = (
    "run_id STRING, sequence BIGINT, kind STRING, state STRING, relative_monotonic_ms BIGINT, "
    "timestamp TIMESTAMP, action_id STRING, action_generation BIGINT, actor STRING, "
    "budget_before STRING, budget_after STRING, artifact_ids ARRAY<STRING>, payload STRING"
)
POSITION = "ARRAY<DOUBLE>"


def _xy(position: Column) -> Column:
    return F.struct(F.element_at(position, 1).alias("x"), F.element_at(position, 2).alias("y"))


def _rings(polygon: Column) -> Column:
    return F.transform(polygon, lambda ring: F.transform(ring, _xy))


def parse_geometry(text: Column) -> dict[str, Column]:
    """GeoJSON geometry text to ``geom_type``, point ``x``/``y`` and polygon ``rings``."""
    point = F.from_json(text, f"coordinates {POSITION}")["coordinates"]
    polygon = F.from_json(text, f"coordinates ARRAY<ARRAY<{POSITION}>>")["coordinates"]
    many = F.flatten(F.from_json(text, f"coordinates ARRAY<ARRAY<ARRAY<{POSITION}>>>")["coordinates"])
    kind = F.get_json_object(text, "$.type")
    is_point = (kind == "Point") & (F.size(point) > 0)
    return {
        "geom_type": kind,
        "x": F.when(is_point, F.try_element_at(point, F.lit(1))),
        "y": F.when(is_point, F.try_element_at(point, F.lit(2))),
        "rings": F.when(kind == "Polygon", _rings(polygon)).when(kind == "MultiPolygon", _rings(many)),
    }


def read_geojson(
    spark: SparkSession,
    path: str,
    crs: str = "EPSG:4326",
    fields: Sequence[str] = (),
    bbox: tuple[float, float, float, float] | None = None,
    properties: T.StructType | str | None = None,
) -> DataFrame:
    """Feature collections: properties as columns plus geometry columns; null geometry is kept.

    The property schema is inferred unless given. ``bbox`` is longitude/latitude and keeps points
    inside it and polygons whose box meets it.
    """
    layout = "type STRING, features ARRAY<STRUCT<properties: STRING, geometry: STRING>>"
    raw = spark.read.option("multiLine", True).schema(layout).json(path)
    if properties is None:
        features = spark.read.option("multiLine", True).json(path).select("features").schema["features"].dataType
        properties = next(f.dataType for f in features.elementType if f.name == "properties")
    bad = F.raise_error(F.lit("source is not a feature collection")).cast(raw.schema["features"].dataType)
    sound = F.coalesce((F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.lit(False))
    # The check is part of the exploded value, so that no derived filter can drop a broken file first.
    features = raw.select(F.explode(F.when(sound, F.col("features")).otherwise(bad)).alias("f"))
    frame = features.select(F.from_json("f.properties", properties).alias("p"), F.col("f.geometry").alias("g"))
    frame = frame.withColumns(parse_geometry(F.col("g"))).select("p.*", "geom_type", "x", "y", "rings")
    if fields:
        require_fields(frame, fields)
        frame = frame.select(*fields, "geom_type", "x", "y", "rings")
    if bbox is not None:
        frame = filter_bbox(frame, *bbox, crs=crs)
    return frame


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float, x: str = "x", y: str = "y", crs: str = "EPSG:4326") -> DataFrame:
    """Box filter given in longitude/latitude, moved into the frame's CRS as constants."""
    spark = df.sparkSession
    if crs != "EPSG:4326":
        corners = spark.range(1).select(
            *geo.transform_point(F.lit(west), F.lit(south), "EPSG:4326", crs),
            *geo.transform_point(F.lit(east), F.lit(north), "EPSG:4326", crs),
        )
        west, south, east, north = corners.first()
    keep = geo.in_bbox(x, y, west, south, east, north)
    if "rings" in df.columns:
        ring = F.element_at("rings", 1)
        xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
        meets = (F.array_min(xs) <= east) & (F.array_max(xs) >= west) & (F.array_min(ys) <= north) & (F.array_max(ys) >= south)
        keep = keep | F.coalesce(meets, F.lit(False))
    return df.filter(keep)


def read_csv_points(
    spark: SparkSession,
    path: str,
    lon: str | None = None,
    lat: str | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    fields: Sequence[str] = (),
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV with header. The box filter runs before the projection and drops unreadable coordinates."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    frame = reader.csv(path)
    if bbox is not None:
        if lon is None or lat is None:
            raise ValueError("box filtering needs longitude and latitude fields")
        require_fields(frame, [lon, lat])
        inside = geo.in_bbox(F.col(lon).try_cast("double"), F.col(lat).try_cast("double"), *bbox)
        frame = frame.filter(inside)
    if fields:
        require_fields(frame, fields)
        frame = frame.select(*fields)
    return frame


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node-link documents to ``nodes(node, attrs)`` and ``edges(src, dst, key, attrs)``.

    Ids become strings; an undirected graph yields both directions of every edge. Attributes sit
    in an ``attributes`` object or flat beside the ids.
    """
    layout = (
        "directed BOOLEAN, multigraph BOOLEAN, nodes ARRAY<MAP<STRING, STRING>>, "
        "edges ARRAY<MAP<STRING, STRING>>, links ARRAY<MAP<STRING, STRING>>"
    )
    raw = spark.read.option("multiLine", True).schema(layout).json(path)

    def attributes(entry: Column, ids: Sequence[str]) -> Column:
        flat = F.map_filter(entry, lambda k, v: ~k.isin(*ids, "attributes"))
        nested = F.coalesce(F.from_json(entry["attributes"], "MAP<STRING, STRING>"), F.create_map().cast("map<string,string>"))
        return F.map_concat(nested, flat)

    nodes = raw.select(F.explode("nodes").alias("n")).select(
        F.col("n")["id"].alias("node"), attributes(F.col("n"), ["id"]).alias("attrs")
    )
    edges = raw.select("directed", "multigraph", F.explode(F.coalesce("edges", "links")).alias("e")).select(
        "directed",
        F.col("e")["source"].alias("src"),
        F.col("e")["target"].alias("dst"),
        F.when(F.col("multigraph"), F.col("e")["key"]).alias("key"),
        attributes(F.col("e"), ["source", "target", "key"]).alias("attrs"),
    )
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = F.when(F.col("directed"), F.slice(ends, 1, 1)).otherwise(ends)
    edges = edges.select(F.explode(both).alias("p"), "key", "attrs").select("p.*", "key", "attrs")
    return nodes, edges


def path_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges for path work: one numeric weight from the attributes, parallel edges reduced to the least."""
    value = F.col("attrs")[weight].cast("double")
    return edges.groupBy("src", "dst").agg(F.min(value).alias("weight"))


def unique_labels(labels: Column, what: str) -> Column:
    """The label array, or an error when a label repeats."""
    bad = F.raise_error(F.lit(f"{what} must be unique")).cast("array<string>")
    return F.when(F.size(F.array_distinct(labels)) == F.size(labels), labels).otherwise(bad)


def dense_to_long(df: DataFrame, rows: str = "row_ids", cols: str = "column_ids", values: str = "values") -> DataFrame:
    """Dense labelled matrices (one per row of ``df``) to ``row_id, col_id, row_ord, col_ord, value``.

    Nulls inside the array stay null; NaN becomes null; a shape that does not fit the labels raises.
    """
    keep = [c for c in df.columns if c not in (rows, cols, values)]
    fits = (F.size(values) == F.size(rows)) & F.forall(values, lambda r: F.size(r) == F.size(F.col(cols)))
    bad = F.raise_error(F.lit("matrix shape does not match its labels")).cast("array<array<double>>")
    checked = df.withColumns(
        {
            rows: unique_labels(F.col(rows), "row labels"),
            cols: unique_labels(F.col(cols), "column labels"),
            values: F.when(fits, F.col(values)).otherwise(bad),
        }
    )
    by_row = checked.select(*keep, rows, cols, F.posexplode(values).alias("row_ord", "_row"))
    cells = by_row.select(*keep, rows, cols, "row_ord", F.posexplode("_row").alias("col_ord", "value"))
    return cells.select(
        *keep,
        F.get(rows, F.col("row_ord")).alias("row_id"),
        F.get(cols, F.col("col_ord")).alias("col_id"),
        "row_ord",
        "col_ord",
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Labelled matrix documents in JSON."""
    layout = "row_ids ARRAY<STRING>, column_ids ARRAY<STRING>, values ARRAY<ARRAY<DOUBLE>>"
    raw = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).schema(layout).json(path)
    return dense_to_long(raw)


def wide_to_long(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """A wide table to ``row_id, col_id, value``."""
    long = df.unpivot([row_id], list(columns), "col_id", "value")
    return long.select(F.col(row_id).cast("string").alias("row_id"), "col_id", F.col("value").cast("double").alias("value"))


def read_region_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Frozen road-distance documents to ``region, from_name, to_name, from_ord, to_ord, meters``.

    Squareness is checked; the region is the file name without its key suffix.
    """
    layout = "locations ARRAY<STRUCT<name: STRING, latitude: DOUBLE, longitude: DOUBLE>>, distances_m ARRAY<ARRAY<DOUBLE>>"
    raw = spark.read.option("multiLine", True).schema(layout).json(path)
    named = raw.withColumn("region", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-[0-9a-f]{8})?\.json$", 1))
    names = F.transform("locations", lambda p: p["name"])
    shaped = named.select("region", names.alias("row_ids"), names.alias("column_ids"), F.col("distances_m").alias("values"))
    cells = dense_to_long(shaped)
    bad = F.raise_error(F.lit("distance matrix contains an invalid value")).cast("double")
    return cells.select(
        "region", F.col("row_id").alias("from_name"), F.col("col_id").alias("to_name"),
        F.col("row_ord").alias("from_ord"), F.col("col_ord").alias("to_ord"),
        F.when(F.col("value").isNull(), bad).otherwise(F.col("value")).alias("meters"),
    )


def signature_mismatch(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Regions whose location list (``region, ord, name, latitude, longitude``) differs from the expected one."""
    a = found.withColumn("_a", F.lit(1))
    b = expected.withColumn("_b", F.lit(1))
    keys = ["region", "ord", "name", "latitude", "longitude"]
    return a.join(b, keys, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull()).select("region").distinct()


CASE_SCHEMA = (
    "prompt STRING, geographic_region STRING, locations ARRAY<STRUCT<name: STRING, latitude: DOUBLE, "
    "longitude: DOUBLE, population: BIGINT>>, answer STRING, centers_to_place INT, "
    "coverage_radius_km DOUBLE, coverage_target_percent DOUBLE"
)


def read_cases(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases to ``cases`` and ``locations`` (one row per place, with its order)."""
    if kind not in ("max_coverage", "minimum_facility", "tsp"):
        raise ValueError(f"unknown case kind {kind}")
    raw = spark.read.option("multiLine", True).schema(CASE_SCHEMA).json(path)
    source = raw.select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"))
    keyed = source.withColumn("row", F.monotonically_increasing_id())
    cases = positions(keyed, [], ["source_path", "block", "row"], name="case_number").drop("block", "row")
    cases = cases.withColumns({"case_id": F.format_string(f"{kind}-%06d", F.col("case_number")), "kind": F.lit(kind)})
    places = cases.select(
        "case_id", "kind", F.col("geographic_region").alias("region"), F.posexplode("locations").alias("ord", "p")
    ).select("case_id", "kind", "region", "ord", "p.*")
    places = places.withColumns(
        {"normalized": normalize_name("name"), "location_id": location_id("region", "name")}
    )
    return cases.drop("locations", "case_number"), places


def case_issues(cases: DataFrame, places: DataFrame) -> DataFrame:
    """Broken cases: ``case_id, code``."""
    coverage = F.col("kind") != "tsp"
    fields = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("prompt"), F.lit("")) == "", F.lit("missing_prompt")),
            F.when(F.coalesce(F.trim("geographic_region"), F.lit("")) == "", F.lit("missing_region")),
            F.when(F.col("answer").isNull(), F.lit("missing_answer")),
            F.when((F.col("kind") == "max_coverage") & F.col("centers_to_place").isNull(), F.lit("missing_centers")),
            F.when(coverage & F.col("coverage_radius_km").isNull(), F.lit("missing_radius")),
            F.when((F.col("kind") == "minimum_facility") & F.col("coverage_target_percent").isNull(), F.lit("missing_target")),
        )
    )
    own = cases.select("case_id", F.explode(fields).alias("code"))
    lonely = cases.join(places, "case_id", "left_anti").select("case_id", F.lit("missing_locations").alias("code"))
    bad_place = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("missing_name")),
            F.when(~F.coalesce(geo.valid_lonlat("longitude", "latitude"), F.lit(False)), F.lit("bad_coordinates")),
            F.when(coverage & F.col("population").isNull(), F.lit("missing_population")),
        )
    )
    per_place = places.select("case_id", F.explode(bad_place).alias("code")).distinct()
    repeated = places.groupBy("case_id", "normalized").count().filter("count > 1")
    repeated = repeated.select("case_id", F.lit("repeated_location").alias("code")).distinct()
    return own.unionByName(lonely).unionByName(per_place).unionByName(repeated)


def read_run_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """Run records from JSON lines or, with ``lines=False``, from whole JSON documents."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_shards(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Union of JSON-lines shards; empty files add nothing, missing columns become null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(list(paths))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_EVENT_SCHEMA).json(path)


def event_gaps(events: DataFrame) -> DataFrame:
    """Runs whose sequence is not exactly 0..n-1: ``run_id, events, last_sequence``.

    Counting distinct sequences needs no ordering, so a run of any length is spread over tasks.
    """
    distinct = events.groupBy("run_id", "sequence").agg(F.count(F.lit(1)).alias("n"))
    runs = distinct.groupBy("run_id").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("steps"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )
    sound = (
        (F.col("first_sequence") == 0) & (F.col("steps") == F.col("events")) & (F.col("last_sequence") + 1 == F.col("events"))
    )
    return runs.filter(~F.coalesce(sound, F.lit(False))).select("run_id", "events", "last_sequence")
