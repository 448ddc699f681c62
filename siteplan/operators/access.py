"""Travel pairs, service benefit, coordinate lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.operators import graph as graphs
from siteplan.operators.overlay import SALT, row_salt
from siteplan.session import shuffle_buckets

KM_PER_DEGREE = geo.EARTH_RADIUS_KM * math.pi / 180


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", row_salt(df))


def _copied(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _columns_in_band(band: Column, height: float) -> Column:
    """Number of longitude cells of a latitude band, fewer towards the poles."""
    low = band * height - 90
    flattest = F.when((low < 0) & (low + height > 0), F.lit(0.0)).otherwise(
        F.least(F.abs(low), F.abs(low + height))
    )
    width = F.cos(F.radians(F.least(flattest, F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(width * 360 / height)).cast("bigint")


def _angles(df: DataFrame, lon: Column, lat: Column, side: str) -> DataFrame:
    """Radians, the cosine of the latitude and the point on the unit sphere, worked out once per row."""
    df = df.withColumns({f"_{side}lam": F.radians(lon), f"_{side}phi": F.radians(lat)})
    lam, phi = F.col(f"_{side}lam"), F.col(f"_{side}phi")
    df = df.withColumns({f"_{side}cos": F.cos(phi), f"_{side}z": F.sin(phi)})
    cos = F.col(f"_{side}cos")
    return df.withColumns({f"_{side}x": cos * F.cos(lam), f"_{side}y": cos * F.sin(lam)})


def pairs_within_sphere(
    origins: DataFrame,
    destinations: DataFrame,
    cutoff_km: float,
    origin: tuple[str, str] = ("o_lon", "o_lat"),
    destination: tuple[str, str] = ("d_lon", "d_lat"),
    name: str | None = "distance_km",
) -> DataFrame:
    """All pairs within ``cutoff_km`` on the sphere, found by an equi-join on latitude/longitude cells.

    Destinations are copied to the cells their search circle touches (about 3 x 3); origins sit
    in one cell. Crowded cells are spread by a salt. Inside a cell the square of the chord tells pairs apart
    without trigonometry; only pairs within a billionth of the cutoff are tested on the distance itself, which
    is worked out for the pairs that stay. With ``name`` None the chord alone decides and no distance is added: a pair
    may then be a billionth of the cutoff too far, for callers with a test of their own.
    """
    olon, olat = map(F.col, origin)
    dlon, dlat = map(F.col, destination)
    height = min(180.0, max(cutoff_km * (1 + 1e-9) / KM_PER_DEGREE, 1e-6))
    top = int(180 // height)
    band = F.least(F.floor((olat + 90) / height), F.lit(top)).cast("bigint")
    left = origins.withColumn("_band", band)
    cells = _columns_in_band(F.col("_band"), height)
    left = left.withColumn("_cell", F.pmod(F.floor((olon + 180) * cells / 360), cells).cast("bigint"))
    left = _angles(_salted(left), olon, olat, "o")

    reach = cutoff_km * (1 + 1e-9) / geo.EARTH_RADIUS_KM
    sin_reach, cos_lat = math.sin(min(reach, math.pi / 2)), F.cos(F.radians(dlat))
    swing = F.when(
        (F.lit(reach) < math.pi / 2) & (cos_lat > sin_reach),
        F.degrees(F.asin(F.least(F.lit(sin_reach) / F.greatest(cos_lat, F.lit(1e-12)), F.lit(1.0)))) + 1e-9,
    ).otherwise(F.lit(180.0))
    home = F.least(F.floor((dlat + 90) / height), F.lit(top)).cast("bigint")
    right = destinations.withColumn(
        "_band", F.explode(F.sequence(F.greatest(home - 1, F.lit(0)), F.least(home + 1, F.lit(top))))
    )
    cells = _columns_in_band(F.col("_band"), height)
    first = F.floor((dlon - swing + 180) * cells / 360).cast("bigint")
    last = F.floor((dlon + swing + 180) * cells / 360).cast("bigint")
    ring = F.sequence(first, F.least(last, first + cells - 1))
    right = right.withColumn("_cell", F.explode(F.array_distinct(F.transform(ring, lambda i: F.pmod(i, cells)))))
    right = _copied(_angles(right, dlon, dlat, "d"))
    apart = [F.col(f"_o{c}") - F.col(f"_d{c}") for c in "xyz"]
    chord = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    distance = geo.great_circle(*[f"_{side}{c}" for side in "od" for c in ("lam", "phi", "cos")])
    # The square of the longest chord; from half the equator on every pair is within the cutoff.
    limit = 4 * math.sin(min(max(cutoff_km, 0.0) / geo.EARTH_RADIUS_KM / 2, math.pi / 2)) ** 2
    surely, maybe = limit * (1 - 1e-9) - 1e-13, limit * (1 + 1e-9) + 1e-13
    keys = ["_band", "_cell", "_salt"]
    right = right.withColumnsRenamed({k: f"_d{k}" for k in keys})
    met = [F.col(k) == F.col(f"_d{k}") for k in keys]
    # Both sides are dealt out by cell: rows of a small file become many pairs, and copies are too many to broadcast.
    left = left.repartition(shuffle_buckets(left.sparkSession), *keys)
    near = chord <= maybe if name is None else (chord <= surely) | ((chord <= maybe) & (distance <= cutoff_km))
    joined = left.join(right.hint("merge"), [*met, near])
    helpers = [*keys, *[f"_d{k}" for k in keys], *[f"_{side}{c}" for side in "od" for c in ("lam", "phi", "cos", "x", "y", "z")]]
    if name is None:
        return joined.drop(*helpers)
    # A generated column: later tests of the distance are not pushed into the join, where each candidate would pay for them.
    return joined.withColumn(name, F.explode(F.array(distance))).drop(*helpers)


def pairs_within_plane(
    origins: DataFrame,
    destinations: DataFrame,
    cutoff: float,
    origin: tuple[str, str] = ("o_x", "o_y"),
    destination: tuple[str, str] = ("d_x", "d_y"),
    name: str = "distance",
) -> DataFrame:
    """All pairs within ``cutoff`` in planar units, by square cells as wide as the cutoff."""
    size = max(cutoff * (1 + 1e-9), 1e-12)
    ox, oy = map(F.col, origin)
    dx, dy = map(F.col, destination)
    left = origins.withColumn("_cx", F.floor(ox / size)).withColumn("_cy", F.floor(oy / size))
    right = destinations.withColumn("_cx", F.explode(F.sequence(F.floor(dx / size) - 1, F.floor(dx / size) + 1)))
    right = right.withColumn("_cy", F.explode(F.sequence(F.floor(dy / size) - 1, F.floor(dy / size) + 1)))
    keys = ["_cx", "_cy", "_salt"]
    # Both sides are dealt out by cell: the copies of a small file are too many to broadcast through the driver.
    left = _salted(left).repartition(shuffle_buckets(left.sparkSession), *keys)
    joined = left.join(_copied(right).hint("merge"), keys).drop(*keys)
    return joined.withColumn(name, geo.euclidean(ox, oy, dx, dy)).filter(F.col(name) <= cutoff)


def all_pairs(origins: DataFrame, destinations: DataFrame, blocks: int = 16) -> DataFrame:
    """The full origin x destination table, which is what a dense travel matrix is.

    Written as an equi-join on destination blocks: no side is broadcast and no task sees more than
    one block of destinations per origin. Prefer a cutoff, whose cost follows the matches.
    """
    keyed = destinations.withColumn("_block", F.pmod(F.xxhash64(*destinations.columns), F.lit(blocks)).cast("int"))
    spread = origins.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(keyed, "_block").drop("_block")


def travel_matrix(
    origins: DataFrame,
    destinations: DataFrame,
    strategy: str,
    units: str = "meters",
    cutoff: float | None = None,
    edges: DataFrame | None = None,
    routed: DataFrame | None = None,
    crs: str = "EPSG:4326",
    meters_per_unit: float = 1.0,
) -> DataFrame:
    """Long travel matrix ``origin_id, destination_id, travel``.

    Inputs are ``origin_id, o_x, o_y`` and ``destination_id, d_x, d_y`` (graph: ``origin_id, node``
    and ``destination_id, node``). Without a cutoff every pair is returned and unreachable pairs are
    Infinity; with one, pairs beyond it are absent.
    """
    ids = ["origin_id", "destination_id"]
    if strategy in ("haversine", "geodesic", "euclidean") and units not in geo.UNIT_METERS:
        raise ValueError("units must be meters or kilometers")
    if strategy == "euclidean":
        if crs == "EPSG:4326":
            raise ValueError("euclidean travel requires a projected CRS")
        scale = geo.UNIT_METERS[units] / meters_per_unit
        pairs = (
            all_pairs(origins, destinations)
            if cutoff is None
            else pairs_within_plane(origins, destinations, cutoff * scale).drop("distance")
        )
        travel = geo.euclidean("o_x", "o_y", "d_x", "d_y", meters_per_unit, units)
        return pairs.select(*ids, travel.alias("travel"))
    if strategy in ("haversine", "geodesic"):
        o, d = check_lonlat(origins, "o_x", "o_y"), check_lonlat(destinations, "d_x", "d_y")
        if cutoff is None:
            pairs = all_pairs(o, d)
        else:
            km = cutoff * geo.UNIT_METERS[units] / 1000
            # The ellipsoid differs from the sphere by less than 0.6 percent; widen, then test exactly.
            wide = km if strategy == "haversine" else km * 1.006
            pairs = pairs_within_sphere(o, d, wide, ("o_x", "o_y"), ("d_x", "d_y"), name=None)
        measure = geo.haversine if strategy == "haversine" else geo.geodesic
        table = pairs.select(*ids, measure("o_x", "o_y", "d_x", "d_y", units).alias("travel"))
        return table if cutoff is None else table.filter(F.col("travel") <= cutoff)
    if strategy == "graph_shortest_path":
        if edges is None:
            raise ValueError("graph travel needs edges")
        costs = graphs.shortest_paths(edges, origins.select("node").distinct(), cutoff)
        wanted = destinations.select("destination_id", F.col("node").alias("target"))
        if cutoff is not None:
            reached = origins.select("origin_id", F.col("node").alias("origin")).join(costs, "origin")
            return reached.join(wanted, F.col("node") == F.col("target")).select(*ids, F.col("cost").alias("travel"))
        pairs = all_pairs(origins.select("origin_id", F.col("node").alias("origin")), wanted)
        lookup = costs.withColumnRenamed("node", "target")
        joined = pairs.join(lookup, ["origin", "target"], "left")
        return joined.select(*ids, F.coalesce("cost", F.lit(math.inf)).alias("travel"))
    if strategy == "routed_provider":
        if routed is None:
            raise ValueError("routed travel needs a parsed routing table")
        o = routed.join(origins.select("origin_id"), "origin_id", "left_semi")
        return o.join(destinations.select("destination_id"), "destination_id", "left_semi").select(*ids, "travel")
    raise ValueError(f"unknown travel strategy {strategy}")


def unreachable_count(matrix: DataFrame, value: str = "travel") -> DataFrame:
    return matrix.agg(F.count_if(F.col(value) == math.inf).alias("unreachable_count"))


def check_lonlat(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Raise on coordinates outside the longitude/latitude ranges (often reversed axes)."""
    message = F.lit("longitude/latitude out of range; check axis reversal")
    checked = F.when(geo.valid_lonlat(lon, lat), F.col(lon)).otherwise(F.raise_error(message).cast("double"))
    return df.withColumn(lon, checked)


def service_benefit(
    access: Column | str,
    strategy: str,
    threshold: float | None = None,
    knots: Sequence[tuple[float, float]] = (),
    decay_scale: float | None = None,
) -> Column:
    """Benefit in [0, 1] of an access cost; null stays null, Infinity gives 0, a negative cost raises."""
    a = F.col(access) if isinstance(access, str) else access
    if strategy == "binary_threshold":
        if threshold is None or threshold < 0:
            raise ValueError("binary threshold needs a non-negative threshold")
        benefit = F.when(a <= threshold, 1.0).otherwise(0.0)
    elif strategy == "piecewise":
        xs, ys = [float(x) for x, _ in knots], [float(y) for _, y in knots]
        if len(knots) < 2 or sorted(set(xs)) != xs or any(p < q for p, q in zip(ys, ys[1:])):
            raise ValueError("knots need increasing access and non-increasing benefit")
        benefit = F.when(a == math.inf, 0.0).when(a <= xs[0], ys[0])
        for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
            benefit = benefit.when(a <= x1, (a - x0) * ((y1 - y0) / (x1 - x0)) + y0)
        benefit = benefit.otherwise(ys[-1])
    elif strategy == "exponential_decay":
        if decay_scale is None or decay_scale <= 0:
            raise ValueError("exponential decay needs a positive scale")
        benefit = F.exp(-a / decay_scale)
    else:
        raise ValueError(f"unknown service strategy {strategy}")
    missing = a.isNull() | F.isnan(a)
    negative = F.raise_error(F.lit("access cannot be negative")).cast("double")
    return F.when(missing, F.lit(None)).when(a < 0, negative).otherwise(benefit)


def service_matrix(matrix: DataFrame, strategy: str, value: str = "travel", name: str = "benefit", **options) -> DataFrame:
    return matrix.withColumn(name, service_benefit(value, strategy, **options))


def service_range(matrix: DataFrame, name: str = "benefit") -> DataFrame:
    finite = F.when(~F.isnan(name) & (F.abs(name) != math.inf), F.col(name))
    return matrix.agg(
        F.coalesce(F.min(finite), F.lit(0.0)).alias("minimum_benefit"),
        F.coalesce(F.max(finite), F.lit(0.0)).alias("maximum_benefit"),
    )


def lookup_coordinates(requests: DataFrame, master: DataFrame, request_id: str, master_order: str, tolerance: float = 1e-8) -> DataFrame:
    """First master row within ``tolerance`` on both axes of each requested ``lon, lat`` (null if none)."""
    size = max(tolerance * 4, 1e-7)
    near = lambda c: F.sequence(F.floor((c - tolerance) / size), F.floor((c + tolerance) / size))
    cells = (
        requests.select(request_id, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
        .withColumn("_cx", F.explode(near(F.col("_lon"))))
        .withColumn("_cy", F.explode(near(F.col("_lat"))))
    )
    # Equal master places compete by order only.
    places = master.groupBy("lon", "lat").agg(F.min(master_order).alias(master_order))
    places = places.withColumn("_cx", F.floor(F.col("lon") / size)).withColumn("_cy", F.floor(F.col("lat") / size))
    close = (F.abs(F.col("_lon") - F.col("lon")) <= tolerance) & (F.abs(F.col("_lat") - F.col("lat")) <= tolerance)
    best = cells.join(places, ["_cx", "_cy"]).filter(close).groupBy(request_id).agg(F.min(master_order).alias(master_order))
    return requests.join(best, request_id, "left")
