"""Field contracts, suppression markers, profiles and id normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteplan.operators.ordered import any_of, positions

# The text markers of a suppressed cell, and what counts as blank around an id.
SUPPRESSION_MARKERS = ("s", "suppressed", "*", "true")
BLANKS = " \t\n\r\x0b\x0c"


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(BLANKS))


def require_fields(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")


def require_single_role(names: Sequence[str]) -> None:
    if len(names) != len(set(names)):
        raise ValueError("a field cannot have more than one role")


def select_roles(df: DataFrame, *names: str) -> DataFrame:
    """Declared columns in order, each once."""
    wanted = list(dict.fromkeys(names))
    require_fields(df, wanted)
    return df.select(*wanted)


def suppressed(df: DataFrame, names: Sequence[str]) -> Column:
    """True where any marker column says so; booleans count as they are, null is not suppressed."""
    require_fields(df, names)

    def marked(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.BooleanType):
            return F.coalesce(F.col(name), F.lit(False))
        text = F.lower(strip(F.col(name).cast("string")))
        return F.coalesce(text.isin(*SUPPRESSION_MARKERS), F.lit(False))

    return any_of([marked(name) for name in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Infinity is kept."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def id_report(df: DataFrame, name: str) -> DataFrame:
    """One row: null ids and repeated ids (counted beyond the first)."""
    counts = df.groupBy(F.col(name).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
    )


def assert_unique_id(df: DataFrame, name: str) -> DataFrame:
    """Run the id check now and return the frame, or raise."""
    report = id_report(df, name).first()
    if report.null_ids or report.duplicate_ids:
        raise ValueError(f"{name} must be non-missing and unique: {report.null_ids} null, {report.duplicate_ids} repeated")
    return df


def checked_numeric(name: str, allow_null: bool = True) -> Column:
    """DOUBLE value of a column; raises on text, NaN, infinite or negative values when evaluated."""
    value = F.col(name).cast("double")
    bad = F.raise_error(F.lit(f"{name} must be finite and non-negative")).cast("double")
    good = (value >= 0) & (value < float("inf"))
    missing = value if allow_null else bad
    return F.when(value.isNull(), missing).when(good, value).otherwise(bad)


def numeric_report(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: how many values are missing, unreadable, not finite or negative."""
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("raw")) for n in names])
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    value = F.expr("try_cast(raw AS DOUBLE)")
    long = long.withColumn("value", value)
    return long.groupBy("field").agg(
        F.count_if(F.col("raw").isNull()).alias("missing"),
        F.count_if(F.col("raw").isNotNull() & F.col("value").isNull()).alias("unreadable"),
        F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("not_finite"),
        F.count_if(F.col("value") < 0).alias("negative"),
    )


def filter_suitable(df: DataFrame, name: str, allowed: Sequence | None = None) -> DataFrame:
    """Keep rows whose value is allowed, or is truthy when no list is given."""
    require_fields(df, [name])
    if allowed:
        return df.filter(F.col(name).isin(*allowed))
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return df.filter(F.length(name) > 0)
    return df.filter(F.col(name).cast("boolean"))


def filter_tags(df: DataFrame, tags: str, all_of: Sequence[str] = (), any_of_column: str | None = None, any_of_tags: Sequence[str] = ()) -> DataFrame:
    """Rows holding every tag of ``all_of`` and overlapping ``any_of_tags`` (either may be empty)."""
    kept = df
    if all_of:
        kept = kept.filter(F.size(F.array_except(F.array(*map(F.lit, all_of)), F.col(tags))) == 0)
    if any_of_tags:
        kept = kept.filter(F.arrays_overlap(F.col(any_of_column or tags), F.array(*map(F.lit, any_of_tags))))
    return kept


def drop_empty_geometry(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, nulls equal."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))


def profile(df: DataFrame, suppression: Sequence[str] = (), geometry: Sequence[str] = ()) -> DataFrame:
    """One row of quality figures; ``geometry`` names the coordinate columns.

    Missing cells are counted over attributes only; equal rows are compared with their geometry.
    """
    attributes = [c for c in df.columns if c not in geometry]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in attributes), F.lit(0).cast("bigint"))
    empty = any_of([F.col(c).isNull() for c in geometry])
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(
            F.try_divide(F.sum(nulls).cast("double"), F.count(F.lit(1)) * len(attributes)), F.lit(0.0)
        ).alias("missing_fraction"),
        F.count_if(empty).alias("empty_geometry_count"),
        F.count_if(suppressed(df, suppression) if suppression else F.lit(False)).alias("suppressed_count"),
    )
    places = df.filter(~empty).select(*geometry) if geometry else None
    figures = base.withColumn("duplicate_count", duplicate_rows(df).scalar()).withColumn(
        "duplicate_geometry_count", duplicate_rows(places).scalar() if geometry else F.lit(0).cast("bigint")
    )
    warnings = {
        "missing_fraction": "missing attribute values",
        "duplicate_count": "duplicate records",
        "empty_geometry_count": "empty geometries",
        "suppressed_count": "suppressed records",
    }
    notes = F.array(*[F.when(F.col(c) > 0, F.lit(m)) for c, m in warnings.items()])
    return figures.withColumn("warnings", F.array_compact(notes))


def quality_summary(df: DataFrame) -> DataFrame:
    """Missing fraction and duplicate count only."""
    return profile(df).select("missing_fraction", "duplicate_count")


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def temporal_extent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Earliest and latest instant over several timestamp columns, nulls skipped."""
    require_fields(df, names)
    stamps = [F.col(n).cast("timestamp") for n in names]
    lows, highs = [F.min(s) for s in stamps], [F.max(s) for s in stamps]
    one = len(names) == 1
    return df.agg(
        (lows[0] if one else F.least(*lows)).alias("start"), (highs[0] if one else F.greatest(*highs)).alias("end")
    )


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def profile_matrix(df: DataFrame, value: str = "value") -> DataFrame:
    missing = F.col(value).isNull() | F.isnan(value)
    return df.agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.try_divide(F.count_if(missing).cast("double"), F.count(F.lit(1))).alias("missing_fraction"),
        F.count_if(F.abs(value) == float("inf")).alias("unreachable_count"),
    )


def profile_raster(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    missing = F.col("value").isNull() | F.isnan("value")
    if nodata is not None:
        missing = missing | (F.col("value") == F.lit(float(nodata)))
    return cells.agg(
        F.countDistinct("band").alias("bands"),
        F.try_divide(F.count_if(missing).cast("double"), F.count(F.lit(1))).alias("missing_fraction"),
    )


def profile_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, and the share of null node attributes (``attrs`` map)."""
    values = nodes.select(F.explode_outer("attrs")).filter(F.col("key").isNotNull())
    share = values.agg(F.coalesce(F.avg(F.col("value").isNull().cast("double")), F.lit(0.0)).alias("m"))
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).withColumns(
        {"edge_count": edges.agg(F.count(F.lit(1)).alias("n")).scalar(), "missing_fraction": share.scalar()}
    )


def normalize_ids(df: DataFrame, source: str | None, out: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """Stable unique-by-suffix ids: blanks become ``prefix-%06d`` by row position, repeats ``value-k``.

    Positions count the rows as given, so drop empty geometries and clip first.
    """
    given = strip(F.col(source).cast("string")) if source else F.lit(None).cast("string")
    placed = positions(df, [], order, name="_pos")
    base = F.when(given.isNull() | (given == ""), F.format_string(f"{prefix}-%06d", F.col("_pos"))).otherwise(given)
    repeats = positions(placed.withColumn("_base", base).drop("_pos"), ["_base"], order, name="_k")
    name = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_k").cast("string")))
    return repeats.withColumn("_repeat", F.col("_k") > 1).withColumn(out, name).drop("_base", "_k")


def scale_units(df: DataFrame, names: Sequence[str], factor: float) -> DataFrame:
    require_fields(df, names)
    return df.withColumns({n: F.col(n).cast("double") * factor for n in names})
