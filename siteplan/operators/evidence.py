"""Demand, candidate and normalised tables: the inputs of a planning problem."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.operators import quality
from siteplan.operators.ordered import any_of
from siteplan.operators.overlay import in_area


def apply_missing_policy(
    df: DataFrame,
    policy: str,
    need: Sequence[str],
    group: Sequence[str] = (),
    time: Sequence[str] = (),
    suppressed: Column | None = None,
) -> DataFrame:
    """``error``, ``drop`` or ``zero`` for rows that miss a dimension without being suppressed."""
    hidden = suppressed if suppressed is not None else F.lit(False)
    missing = any_of([F.col(c).isNull() for c in [*need, *group, *time]]) & ~hidden
    if policy == "drop":
        return df.filter(~missing)
    if policy == "error":
        raised = F.raise_error(F.lit("demand misses unsuppressed dimensions")).cast("boolean")
        return df.filter(F.when(missing, raised).otherwise(F.lit(True)))
    if policy == "zero":
        loose = any_of([F.col(c).isNull() for c in [*group, *time]])
        raised = F.raise_error(F.lit("zero policy applies to need fields only")).cast("boolean")
        kept = df.filter(F.when(loose, raised).otherwise(F.lit(True)))
        return kept.fillna(0, list(need))
    raise ValueError(f"unknown missing-data policy {policy}")


def build_demand(
    df: DataFrame,
    location_id: str,
    need: Sequence[str],
    group: Sequence[str] = (),
    time: Sequence[str] = (),
    suppression: Sequence[str] = (),
    policy: str = "error",
    geometry: Sequence[str] = (),
    check_ids: bool = True,
) -> DataFrame:
    """Canonical demand: declared roles only, numeric needs, missing policy, ``suppressed`` flag.

    Row checks raise when the result is evaluated; the id check runs at once.
    """
    roles = [*need, *group, *time, *suppression]
    quality.require_single_role(roles)
    if check_ids:
        quality.assert_unique_id(df, location_id)
    canonical = quality.select_roles(df, location_id, *roles, *geometry)
    flag = quality.suppressed(canonical, suppression) if suppression else F.lit(False)
    canonical = canonical.withColumns(
        {location_id: F.col(location_id).cast("string"), "is_suppressed": flag}
        | {n: quality.checked_numeric(n) for n in need}
    )
    return apply_missing_policy(canonical, policy, need, group, time, F.col("is_suppressed"))


def grid_points(spark: SparkSession, bounds: tuple[float, float, float, float], spacing: float, id_name: str = "site_id") -> DataFrame:
    """Row-major point grid (by y, then x) with ids ``grid-%06d`` without gaps; only points inside the bounds."""
    west, south, east, north = map(float, bounds)
    if spacing <= 0 or east < west or north < south:
        raise ValueError("grid needs a positive spacing and ordered bounds")
    columns = int((east - west) / spacing + 1e-9) + 1
    rows = int((north - south) / spacing + 1e-9) + 1
    # A last step that rounding carries over the edge is no column or row.
    columns -= (columns - 1) * spacing + west > east
    rows -= (rows - 1) * spacing + south > north
    cells = spark.range(columns * rows).select(
        F.col("id"), (F.col("id") % columns).alias("c"), F.floor(F.col("id") / columns).alias("r")
    )
    return cells.select(
        F.format_string("grid-%06d", F.col("id") + 1).alias(id_name),
        (F.col("c") * spacing + west).alias("x"),
        (F.col("r") * spacing + south).alias("y"),
    )


def build_candidates(
    df: DataFrame,
    site_id: str,
    cost: str | None = None,
    capacity: str | None = None,
    eligibility: str | None = None,
    existing: str | None = None,
    suitability: str | None = None,
    allowed: Sequence | None = None,
    areas: DataFrame | None = None,
    area_predicate: str = "within",
    geometry: tuple[str, str] = ("x", "y"),
    check_ids: bool = True,
) -> DataFrame:
    """Canonical candidates from supplied or grid points, filtered by attribute or by area."""
    if check_ids:
        quality.assert_unique_id(df, site_id)
    frame = df.withColumn(site_id, F.col(site_id).cast("string"))
    fields = [f for f in (site_id, cost, capacity, eligibility, existing) if f]
    if areas is None and suitability:
        frame = quality.filter_suitable(frame, suitability, allowed)
        fields.append(suitability)
    elif areas is not None:
        chosen = quality.filter_suitable(areas, suitability, allowed) if suitability else areas
        frame = in_area(frame, chosen, area_predicate, *geometry)
    for name in (cost, capacity):
        if name:
            frame = frame.withColumn(name, quality.checked_numeric(name))
    return quality.select_roles(frame, *fields, *geometry)


def normalize(
    df: DataFrame,
    order: Sequence[str],
    source_id: str | None = None,
    out_id: str = "id",
    prefix: str = "record",
    value_fields: Sequence[str] = (),
    factor: float = 1.0,
    source_crs: str | None = None,
    target_crs: str | None = None,
    clip: DataFrame | None = None,
    geometry: tuple[str, str] = ("x", "y"),
    drop_empty: bool = True,
) -> DataFrame:
    """CRS change, point clipping, empty-geometry drop, stable ids and unit scaling, in that order."""
    frame = df
    x, y = geometry
    if target_crs:
        new_x, new_y = geo.transform_point(x, y, source_crs, target_crs)
        frame = frame.withColumns({x: new_x, y: new_y})
    if clip is not None:
        frame = in_area(frame, clip, "intersects", x, y)
    if drop_empty and x in frame.columns:
        frame = quality.drop_empty_geometry(frame, x, y)
    source = source_id or (out_id if out_id in frame.columns else None)
    frame = quality.normalize_ids(frame, source, out_id, prefix, order)
    return quality.scale_units(frame, value_fields, factor) if value_fields else frame


def scenario_demand(demand: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Demand per scenario: need times the row's multiplier (1 where a scenario has none).

    ``multipliers`` holds ``scenario, demand_id, multiplier``; a scenario whose total is not positive raises.
    """
    names = multipliers.select("scenario").distinct()
    names = names.agg(F.sort_array(F.collect_set("scenario"))).scalar()
    spread = demand.withColumn("_s", names).withColumn("scenario", F.explode("_s")).drop("_s")
    joined = spread.join(multipliers, ["scenario", "demand_id"], "left")
    weighted = joined.withColumn("need", F.col("need") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    totals = weighted.groupBy("scenario").agg(F.sum("need").alias("_total"))
    message = F.raise_error(F.lit("each scenario must keep positive demand")).cast("double")
    guarded = F.when(F.col("_total") > 1e-9, F.col("need")).otherwise(message)
    return weighted.join(totals, "scenario").withColumn("need", guarded).drop("_total")
