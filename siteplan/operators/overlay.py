"""Joins and reductions by location: spatial join, zonal statistics, nearest feature, raster sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteplan.functions import geo
from siteplan.operators.ordered import positions, running
from siteplan.session import cut_lineage, shuffle_buckets

SALT = 8
#: Where a grid level has at most so many polygons, their cells are cut to a 32nd, a 16th or a quarter of their side.
FEW, SOME, MANY = 256, 4096, 65_536
LEAF_POINTS = 64
#: Distance of a spot beside a point, as a share of its coordinates.
NEARBY = 1e-7


def row_salt(df: DataFrame, salt: int = SALT) -> Column:
    """Salt from the whole row, so that rows at one place are spread as well (maps cannot be hashed)."""
    hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*hashable), F.lit(salt)).cast("int")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("bigint")


def _cover(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(_cell(low, size), _cell(high, size))


def _level(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Grid level whose cells are at least as wide as the box."""
    side = F.greatest(east - west, north - south)
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(-20)).cast("int")
    return F.greatest(F.lit(-20), F.least(F.lit(40), level))


CELL_KEYS = ["_level", "_cx", "_cy"]


def _bounds(rings: str) -> tuple[Column, Column, Column, Column]:
    outer = F.element_at(F.col(rings), 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _touches(edge: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an edge comes into a box: their boxes overlap and the corners are not all on one side of it."""
    apart = (
        (F.greatest(edge["x1"], edge["x2"]) < west) | (F.least(edge["x1"], edge["x2"]) > east)
        | (F.greatest(edge["y1"], edge["y2"]) < south) | (F.least(edge["y1"], edge["y2"]) > north)
    )
    sides = [(edge["x2"] - edge["x1"]) * (cy - edge["y1"]) - (edge["y2"] - edge["y1"]) * (cx - edge["x1"]) for cx in (west, east) for cy in (south, north)]
    return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _finer(cells: DataFrame, bits: int) -> DataFrame:
    """Replace each cell by those of its parts, 2 ** bits a side, that the polygon meets, with the edges that come near them.

    A part without edges lies inside or outside as a whole. Parts are taken a little larger for the test, so an edge along
    their side counts as near. Inner cells have inner parts.
    """
    side = 2**bits
    split = cells.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).withColumns({
        "_level": F.col("_level") - bits, "_cx": F.col("_cx") * side + F.col("_part") % side, "_cy": F.col("_cy") * side + F.floor(F.col("_part") / side),
    }).drop("_part")
    size = F.pow(F.lit(2.0), F.col("_level"))
    west, south = F.col("_cx") * size, F.col("_cy") * size
    slack = size * 1e-6 + F.greatest(F.abs(west), F.abs(south)) * 1e-12
    box = F.struct((west - slack).alias("w"), (south - slack).alias("s"), (west + size + slack).alias("e"), (south + size + slack).alias("n"))
    near = F.filter("_edges", lambda e: _touches(e, F.col("_box.w"), F.col("_box.s"), F.col("_box.e"), F.col("_box.n")))
    # Exploded, so that the edges are looked through once.
    tested = split.withColumn("_box", box).withColumn("_near", F.explode(F.array(F.when(F.col("_inner"), F.col("_edges")).otherwise(near))))
    inside = geo.inside_segments((F.col("_box.w") + F.col("_box.e")) / 2, (F.col("_box.s") + F.col("_box.n")) / 2, F.col("_all"))
    known = F.when(F.col("_inner"), True).when(F.size("_near") > 0, False).otherwise(F.when(inside, True))
    return tested.withColumn("_inner", known).withColumn("_edges", F.col("_near")).drop("_near", "_box").filter(F.col("_inner").isNotNull())


def polygon_cells(polygons: DataFrame, rings: str, keep_rings: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cells that cover each polygon, and the grid levels in use (``levels``, a row with one array).

    A polygon meets at most 2 x 2 cells of the level that fits its box. Where a level has few polygons, as the levels of
    large ones have, these cells are cut into parts, once or twice: a large polygon gets hundreds of cells, so its points
    are spread over as many keys. ``_inner`` cells lie inside as a whole; only points in the others need the edges, and
    unless ``keep_rings`` only the others have them.
    """
    sides = _bounds(rings)
    placed = polygons.withColumn("_level", _level(*sides))
    counts = placed.groupBy("_level").agg(F.count(F.lit(1)).alias("_n"))
    second = F.when(F.col("_n") <= FEW, 3).when(F.col("_n") <= SOME, 2).otherwise(0)
    # At most one row per level there is.
    cuts = counts.select("_level", F.when(F.col("_n") <= MANY, 2).otherwise(0).alias("_first"), second.alias("_second"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    cells = placed.join(F.broadcast(cuts), "_level").withColumn("_cx", F.explode(_cover(sides[0], sides[2], size))).withColumn("_cy", F.explode(_cover(sides[1], sides[3], size)))
    cells = cells.withColumn("_inner", F.lit(False))
    part = cells.filter("_first > 0").withColumn("_all", geo.segments(rings)).withColumn("_edges", F.col("_all"))
    once = cut_lineage(_finer(part, 2).repartition(shuffle_buckets(polygons.sparkSession), "_level", "_cx", "_cy"))
    cut = once.filter("_second = 0")
    for bits in (2, 3):
        cut = cut.unionByName(_finer(once.filter(F.col("_second") == bits), bits))
    if not keep_rings:
        cut = cut.withColumn(rings, F.when(~F.col("_inner"), F.col(rings)))
    helpers = ["_first", "_second"]
    cells = cells.filter("_first = 0").drop(*helpers).unionByName(cut.drop("_all", "_edges", *helpers))
    return cut_lineage(cells), cuts.agg(F.collect_set(F.col("_level") - F.col("_first") - F.col("_second")).alias("levels"))


def pair_points_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, keep_rings: bool = False) -> DataFrame:
    """Candidate pairs whose point lies in a cell of the polygon, each pair once; ``_inner`` ones lie inside for certain."""
    cells, levels = polygon_cells(polygons, rings, keep_rings)
    spots = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_levels", levels.scalar())
    spots = spots.withColumn("_level", F.explode("_levels")).drop("_levels")
    size = F.pow(F.lit(2.0), F.col("_level"))
    spots = spots.withColumn("_cx", _cell(F.col(x), size)).withColumn("_cy", _cell(F.col(y), size))
    return spots.join(cells, CELL_KEYS).drop(*CELL_KEYS)


def _decided(test: Column, predicate: str) -> Column:
    """The outcome of a predicate for a candidate pair: known for inner ones, else by the edges."""
    return F.when(F.col("_inner"), F.lit(predicate in ("within", "intersects", "contains", "covers"))).otherwise(test)


def _prefixed(df: DataFrame, prefix: str, skip: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in skip else f"{prefix}_{c}") for c in df.columns])


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: str = "intersects",
    prefix: str = "overlay",
    left_kind: str = "point",
    x: str = "x",
    y: str = "y",
    rings: str = "rings",
) -> DataFrame:
    """One row per matching pair; the right side's columns are prefixed, its geometry dropped.

    ``left_kind='point'`` joins points to polygons, ``'polygon'`` joins polygons to points.
    """
    if left_kind == "point":
        other = _prefixed(right, prefix, skip=(rings,)).withColumnRenamed(rings, "_rings")
        pairs = pair_points_polygons(left, other, x, y, "_rings")
        # A point never contains a polygon.
        hits = geo.point_polygon(x, y, "_rings", predicate)
        return pairs.filter(hits if predicate in ("contains", "covers") else _decided(hits, predicate)).drop("_rings", "_inner")
    other = _prefixed(right, prefix, skip=(x, y)).withColumnsRenamed({x: "_x", y: "_y"})
    pairs = pair_points_polygons(other, left, "_x", "_y", rings, keep_rings=True)
    hits = geo.polygon_point("_x", "_y", rings, predicate)
    matched = pairs.filter(hits if predicate == "within" else _decided(hits, predicate))
    keep = [c for c in other.columns if c not in ("_x", "_y")]
    return matched.select(*left.columns, *keep)


def box_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", prefix: str = "overlay") -> DataFrame:
    """Spatial join of two tables of boxes (west, south, east, north).

    Two boxes meet at the grid level of the larger one: there a box of that level has at most four cells, and the smaller
    box is moved up to it. Small boxes therefore never meet one another in the cells of large ones.
    """
    other = _prefixed(right, prefix)
    sides = ("west", "south", "east", "north")
    corners = [F.col(s) for s in sides], [F.col(f"{prefix}_{s}") for s in sides]
    levels = left.agg(F.collect_set(_level(*corners[0]))).scalar(), other.agg(F.collect_set(_level(*corners[1]))).scalar()

    def at_levels(df: DataFrame, cols: list[Column], reached: Column | None, strict: bool = False) -> DataFrame:
        """Cells of each box at its own level, or at the levels of the other side from its own (beyond it if strict) up."""
        spread = df.withColumn("_level", _level(*cols))
        if reached is not None:
            up = F.filter("_reached", lambda level: level > F.col("_level") if strict else level >= F.col("_level"))
            spread = spread.withColumn("_reached", reached).withColumn("_level", F.explode(up)).drop("_reached")
        size = F.pow(F.lit(2.0), F.col("_level"))
        return spread.withColumn("_cx", F.explode(_cover(cols[0], cols[2], size))).withColumn("_cy", F.explode(_cover(cols[1], cols[3], size)))

    met = None
    for a, b in (
        (at_levels(left, corners[0], None), at_levels(other, corners[1], levels[0])),
        (at_levels(left, corners[0], levels[1], strict=True), at_levels(other, corners[1], None)),
    ):
        pairs = a.join(b, ["_level", "_cx", "_cy"])
        met = pairs if met is None else met.unionByName(pairs)
    size = F.pow(F.lit(2.0), F.col("_level"))
    # Of the cells both boxes share, the one holding the corner of their overlap reports the pair.
    home = (F.col("_cx") == _cell(F.greatest("west", f"{prefix}_west"), size)) & (F.col("_cy") == _cell(F.greatest("south", f"{prefix}_south"), size))
    named = met.select("*", *[F.col(s).alias(f"_l{s}") for s in sides])
    return named.filter(home & geo.box_box("_l", f"{prefix}_", predicate)).select(*left.columns, *other.columns)


def in_area(points: DataFrame, areas: DataFrame, predicate: str = "within", x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Keep the points inside (``within``) or touching (``intersects``) the union of the areas.

    A point on edges is inside the union if the areas that touch it cover everything around it: between each two
    neighbouring directions of edges that leave the point, a spot close to it must lie in one of them.
    """
    marked = points.withColumn("_pid", F.struct(F.col(x), F.col(y)))
    spots = marked.select("_pid", F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    pairs = pair_points_polygons(spots, areas.select(F.col(rings).alias("_rings")), "_x", "_y", "_rings")
    edge = ~F.col("_inner") & geo.on_boundary("_x", "_y", "_rings")
    inner = F.col("_inner") | (~geo.on_boundary("_x", "_y", "_rings") & geo.inside_rings("_x", "_y", "_rings"))
    hits = pairs.select("_pid", "_x", "_y", "_rings", inner.alias("inner"), edge.alias("edge")).filter("inner or edge")
    if predicate == "within":
        inside = hits.filter("inner").select("_pid").distinct()
        open_ = hits.filter("edge").join(inside, "_pid", "left_anti")
        found = inside.unionByName(_surrounded(open_.select("_pid", "_x", "_y", "_rings")))
    elif predicate == "intersects":
        found = hits.select("_pid").distinct()
    else:
        raise ValueError("area predicate must be within or intersects")
    return marked.join(found.select("_pid"), "_pid", "left_semi").drop("_pid")


def _surrounded(touching: DataFrame) -> DataFrame:
    """Points (``_pid``) that the polygons touching them, one per row, cover on all sides."""
    sides = touching.select("_pid", "_x", "_y", F.explode(geo.edge_directions("_x", "_y", "_rings")).alias("_angle")).distinct()
    around = Window.partitionBy("_pid").orderBy("_angle")
    first = F.min("_angle").over(Window.partitionBy("_pid"))
    middle = (F.col("_angle") + F.coalesce(F.lead("_angle").over(around), first + 2 * math.pi)) / 2
    reach = F.greatest(F.abs("_x"), F.abs("_y"), F.lit(1.0)) * NEARBY
    probes = sides.select("_pid", middle.alias("_middle"), (F.col("_x") + reach * F.cos(middle)).alias("_px"), (F.col("_y") + reach * F.sin(middle)).alias("_py"))
    tested = probes.join(touching.select("_pid", "_rings"), "_pid")
    covered = tested.groupBy("_pid", "_middle").agg(F.max(geo.point_polygon("_px", "_py", "_rings", "intersects")).alias("_in"))
    return covered.groupBy("_pid").agg(F.min("_in").alias("_in")).filter("_in").select("_pid")


REDUCERS = {
    "sum": lambda v, o: F.sum(v),
    "mean": lambda v, o: F.avg(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
}


def zonal(
    zones: DataFrame,
    features: DataFrame,
    zone_id: str,
    values: Sequence[str] = (),
    reducer: str | Sequence[str] = "sum",
    predicate: str = "intersects",
    order: str | None = None,
    prefix: str = "overlay",
    x: str = "x",
    y: str = "y",
    rings: str = "rings",
) -> DataFrame:
    """Reduce point values per zone; a zone without features gets count 0, other reducers null.

    Several reducers share one spatial join. Nulls are skipped; ``first`` needs the column that orders the features.
    """
    reducers = [reducer] if isinstance(reducer, str) else list(reducer)
    if any(r != "count" for r in reducers) and not values:
        raise ValueError("values are required unless reducer is count")
    if "first" in reducers and order is None:
        raise ValueError("first needs an order column")
    slim = features.select(x, y, *dict.fromkeys([*values, *([order] if order else [])]))
    shapes = zones.select(F.col(zone_id).alias("_zone"), F.col(rings).alias("_rings"))
    pairs = pair_points_polygons(slim, shapes, x, y, "_rings").filter(_decided(geo.zone_feature(x, y, "_rings", predicate), predicate))
    rank = F.col(order) if order else F.lit(0)
    outputs = {}
    for r in reducers:
        if r == "count":
            outputs[f"{prefix}_count"] = F.count(F.lit(1))
        else:
            outputs |= {f"{prefix}_{v}_{r}": REDUCERS[r](F.col(v) if r == "first" else F.col(v).cast("double"), rank) for v in values}
    reduced = pairs.groupBy("_zone").agg(*[c.alias(n) for n, c in outputs.items()])
    joined = zones.join(reduced, F.col(zone_id) == F.col("_zone"), "left").drop("_zone")
    return joined.fillna(0, [f"{prefix}_count"]) if "count" in reducers else joined


def _affine(header: dict) -> tuple[float, ...]:
    return tuple(float(header[k]) for k in "abcdef")


def cell_centres(cells: DataFrame, header: dict) -> DataFrame:
    """Add the centre of every raster cell from the affine header a..f."""
    a, b, c, d, e, f = _affine(header)
    col, row = F.col("col") + 0.5, F.col("row") + 0.5
    return cells.withColumn("x", col * a + row * b + c).withColumn("y", col * d + row * e + f)


def valid_cells(cells: DataFrame, header: dict) -> DataFrame:
    """Drop NaN, null and nodata cells."""
    kept = cells.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    nodata = header.get("nodata")
    return kept if nodata is None else kept.filter(F.col("value") != F.lit(float(nodata)))


def zonal_raster(
    zones: DataFrame, cells: DataFrame, header: dict, zone_id: str, reducer: str = "sum", rings: str = "rings"
) -> DataFrame:
    """Reduce the raster cells whose centre lies in the zone: one row per zone and band."""
    centred = cell_centres(valid_cells(cells, header), header)
    shapes = zones.select(zone_id, F.col(rings).alias("_rings"))
    pairs = pair_points_polygons(centred.select("band", "value", "x", "y"), shapes, "x", "y", "_rings")
    hits = pairs.filter(_decided(geo.point_polygon("x", "y", "_rings", "intersects"), "intersects"))
    agg = F.count("value") if reducer == "count" else REDUCERS[reducer](F.col("value"), F.struct("y", "x"))
    reduced = hits.groupBy(zone_id, "band").agg(agg.alias("value"))
    bands = cells.agg(F.array_sort(F.collect_set("band"))).scalar()
    grid = zones.select(zone_id).withColumn("_bands", bands).select(zone_id, F.explode("_bands").alias("band"))
    joined = grid.join(reduced, [zone_id, "band"], "left")
    return joined.fillna(0, ["value"]) if reducer == "count" else joined


def pixel_of(x, y, header: dict) -> tuple[Column, Column]:
    """(row, col) of a point by the inverse affine transform, floored."""
    a, b, c, d, e, f = _affine(header)
    det = a * e - b * d
    if det == 0:
        raise ValueError("raster transform is not invertible")
    px, py = F.col(x) - c, F.col(y) - f
    return (
        F.floor((py * a - px * d) / det).cast("int"),
        F.floor((px * e - py * b) / det).cast("int"),
    )


def sample_raster(points: DataFrame, cells: DataFrame, header: dict, bands: Sequence[int] = (1,), prefix: str = "overlay", x: str = "x", y: str = "y") -> DataFrame:
    """Left join of points to raster cells: one column per band, null outside and on nodata."""
    row, col = pixel_of(x, y, header)
    wide = valid_cells(cells, header).groupBy("row", "col").agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"{prefix}_band_{b}") for b in bands]
    )
    # A pixel can hold a third of the points: salt the points, copy the cell rows.
    wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    placed = (
        points.withColumn("row", row)
        .withColumn("col", col)
        .withColumn("_salt", row_salt(points))
    )
    return placed.join(wide, ["row", "col", "_salt"], "left").drop("row", "col", "_salt")


def _spread(value: Column) -> Column:
    """The 31 bits of a number, each followed by a zero bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def z_order(x: Column, y: Column, origin: tuple[float, float], span: float) -> Column:
    """Place of a point on the Z-order curve over a square; points outside are moved to its edge."""
    def steps(value: Column, low: float) -> Column:
        share = F.least(F.greatest((value - F.lit(low)) / F.lit(span), F.lit(0.0)), F.lit(1.0))
        return (share * (2**31 - 1)).cast("bigint")

    return F.shiftleft(_spread(steps(y, origin[1])), 1).bitwiseOR(_spread(steps(x, origin[0])))


def leaf_directory(sites: DataFrame, origin: tuple[float, float], span: float) -> DataFrame:
    """Add ``_z`` and ``_leaf``: runs of ``LEAF_POINTS`` places (``_rx, _ry``, distinct) along the Z-order curve.

    Leaves hold equally many places however they are spread; their bounds are a table as long as there are leaves.
    """
    curved = sites.withColumn("_z", z_order(F.col("_rx"), F.col("_ry"), origin, span))
    ranked = positions(curved, [], ["_z", "_rx", "_ry"], name="_place")
    return ranked.withColumn("_leaf", F.floor((F.col("_place") - 1) / LEAF_POINTS)).drop("_place")


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    right_order: str,
    values: Sequence[str] = (),
    max_distance: float | None = None,
    prefix: str = "overlay",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Nearest right point of every left point, the first in right order on ties (planar units).

    The right places are cut into leaves of equal size along the Z-order curve. A left place starts at the leaf where it
    would stand on that curve: the nearest place there bounds its distance. The square of that bound around it is joined
    with the bounds of the leaves, each pair at the grid level of the larger box, and only places of leaves that the
    circle of the bound touches are measured. No key is common to all rows, and no loop is needed: far left points,
    dense right clusters and places that hold many points (each counts once) all take the same three joins.
    Points without two coordinates (null or NaN) match nothing.
    """
    outputs = [right_id, *values]
    renamed = {v: f"{prefix}_{v}" for v in outputs}
    point = F.struct(*[F.col(c).alias(n) for c, n in renamed.items()])

    def placed(df: DataFrame) -> DataFrame:
        return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))

    # Equal coordinates can only win by order: one row per place.
    sites = placed(right).groupBy(F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry")).agg(
        F.min(F.col(right_order)).alias("_ord"), F.min_by(point, F.col(right_order)).alias("_hit")
    )
    sites = cut_lineage(sites)
    west, south, east, north = sites.agg(F.min("_rx"), F.min("_ry"), F.max("_rx"), F.max("_ry")).first()
    empty_hit = F.lit(None).cast(sites.schema["_hit"].dataType)
    if west is None:
        none = left.withColumn("_best", F.lit(None).cast("double")).withColumn("_hit", empty_hit)
        return none.select(*left.columns, F.col("_best").alias(f"{prefix}_distance"), "_hit.*")
    origin, span = (west, south), max(east - west, north - south) or 1.0
    leaved = cut_lineage(leaf_directory(sites, origin, span))
    bounds = leaved.groupBy("_leaf").agg(
        F.min("_rx").alias("_w"), F.min("_ry").alias("_s"), F.max("_rx").alias("_e"), F.max("_ry").alias("_n"), F.min(F.struct("_z", "_rx", "_ry")).alias("_head")
    )
    bounds = cut_lineage(bounds)
    heads = bounds.select("_head._z", F.col("_head._rx").alias("_x"), F.col("_head._ry").alias("_y"), F.lit(0).alias("_kind"), F.col("_leaf").alias("_own"))
    places = placed(left).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
    curved = places.select(z_order(F.col("_x"), F.col("_y"), origin, span).alias("_z"), "_x", "_y", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_own"))
    stood = running(heads.unionByName(curved), [], ["_z", "_x", "_y", "_kind"], {"_leaf": ("last", F.col("_own"))}).filter("_kind = 1")
    started = stood.select("_x", "_y", F.coalesce("_leaf", F.lit(0).cast("bigint")).alias("_leaf"))
    away = geo.euclidean("_x", "_y", "_rx", "_ry")
    started = cut_lineage(started.join(leaved, "_leaf").groupBy("_x", "_y").agg(F.min(away).alias("_bound")))

    # Boxes in steps of the span, so that grid levels fit any unit; bounds are widened by what rounding may cost.
    step = span / 2**20
    wide = F.col("_bound") * (1 + 1e-9) + step * 1e-6

    def boxed(df: DataFrame, w: Column, s_: Column, e: Column, n: Column) -> DataFrame:
        scaled = {"west": (w - west) / step, "south": (s_ - south) / step, "east": (e - west) / step, "north": (n - south) / step}
        return df.withColumns(scaled)

    circles = boxed(started, F.col("_x") - wide, F.col("_y") - wide, F.col("_x") + wide, F.col("_y") + wide)
    boxes = boxed(bounds.drop("_head"), F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n"))
    met = box_join(circles, boxes, prefix="b")
    near_x = F.greatest(F.col("b__w") - F.col("_x"), F.col("_x") - F.col("b__e"), F.lit(0.0))
    near_y = F.greatest(F.col("b__s") - F.col("_y"), F.col("_y") - F.col("b__n"), F.lit(0.0))
    touched = met.filter(F.hypot(near_x, near_y) <= wide).select("_x", "_y", F.col("b__leaf").alias("_leaf"))
    best = touched.join(leaved, "_leaf").withColumn("_d", away).groupBy("_x", "_y").agg(
        F.min("_d").alias("_best"), F.min_by("_hit", F.struct("_d", "_ord")).alias("_hit")
    )
    if max_distance is not None:
        best = best.filter(F.col("_best") <= max_distance)
    joined = left.join(best, (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y")), "left")
    return joined.select(*left.columns, F.col("_best").alias(f"{prefix}_distance"), "_hit.*")


def overlay(left: DataFrame, right: DataFrame, operation: str, **options) -> DataFrame:
    """Named entry to the four overlay operations."""
    operations = {
        "spatial_join": spatial_join,
        "zonal_aggregation": zonal,
        "nearest_feature": nearest,
        "raster_sampling": sample_raster,
    }
    if operation not in operations:
        raise ValueError(f"unknown overlay operation {operation}")
    return operations[operation](left, right, **options)
