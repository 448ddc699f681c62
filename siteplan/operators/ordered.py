"""Ordered operators that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task, and a window
without keys puts the whole table there. Here every ordered operator works in two levels:

1. rows are cut into range buckets of the order columns. The bucket bounds come from a fixed-size
   uniform sample (the rows with the smallest hashes), read as a scalar subquery;
2. one small aggregate per (key, bucket) is combined by a window over the buckets, and its result
   is joined back to the rows, whose own window covers one (key, bucket) only.

A key therefore contributes at most one row per bucket to step 2, and a hot key is spread over as
many tasks as it has buckets. The order columns must be unique within a key for a fixed answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteplan.session import cut_lineage, shuffle_buckets

SAMPLE_PER_BUCKET = 32
BUCKET = "_bucket"
FEW_BUCKETS = 32


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in names]


def _bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> Column:
    """The inner bounds of ``count`` range buckets of the order columns, null for an empty table."""
    order_key = F.struct(*_cols(order))
    spread = F.xxhash64(*_cols([*keys, *order]))
    sample = (
        df.select(order_key.alias("k"), spread.alias("h"))
        .orderBy("h")
        .limit(SAMPLE_PER_BUCKET * count)
        .agg(F.sort_array(F.collect_list("k")).alias("a"))
    )
    return sample.select(
        F.when(
            F.size("a") > 0,
            F.transform(
                F.sequence(F.lit(1), F.lit(count - 1)),
                lambda i: F.element_at(
                    "a", F.greatest(F.lit(1), (i * F.size("a") / F.lit(count)).cast("int"))
                ),
            ),
        )
    ).scalar()


def with_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Add the range bucket of the order columns; a hot key gets its share of the bounds."""
    count = buckets or shuffle_buckets(df.sparkSession)
    order_key = F.struct(*_cols(order))
    stride = max(1, math.isqrt(count - 1))
    # Two-step search: every stride-th bound first, then the bounds of that stretch only.
    coarse = F.size(
        F.filter(
            F.transform(
                F.sequence(F.lit(stride), F.lit(max(stride, count - 1)), F.lit(stride)),
                lambda i: F.try_element_at("_bounds", i),
            ),
            lambda bound: bound <= order_key,
        )
    )
    fine = F.size(
        F.filter(
            F.slice("_bounds", F.col("_coarse") * stride + 1, F.lit(stride)),
            lambda bound: bound <= order_key,
        )
    )
    return (
        df.withColumn("_bounds", _bounds(df, keys, order, count))
        .withColumn("_coarse", F.greatest(coarse, F.lit(0)))
        .withColumn(BUCKET, F.col("_coarse") * stride + F.greatest(fine, F.lit(0)))
        .drop("_bounds", "_coarse")
    )


def _prefix(df: DataFrame, keys: Sequence[str]) -> Window:
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(parts, [*keys, BUCKET])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank of each row by ``order`` within ``keys`` (whole table when empty)."""
    rows = with_bucket(df, keys, order, buckets)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    parts = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(_prefix(rows, keys)), F.lit(0)))
    )
    if total:
        parts = parts.withColumn(total, F.sum("_rows").over(whole))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*_cols(order))
    ranked = rows.withColumn("_rank", F.row_number().over(inner))
    return (
        _attach(ranked, parts.drop("_rows"), keys)
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_rank", "_offset", BUCKET)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Running ``sum``, ``count``, ``max``, ``min``, ``first`` or ``last`` (nulls skipped).

    With ``inclusive=False`` the frame ends at the previous row.
    """
    values = {f"_v{i}": column for i, (_, column) in enumerate(outputs.values())}
    kinds = [kind for kind, _ in outputs.values()]
    rows = with_bucket(df.select("*", *[c.alias(n) for n, c in values.items()]), keys, order, buckets)
    order_key = F.struct(*_cols(order))
    partial = {
        "sum": F.sum,
        "count": F.count,
        "max": F.max,
        "min": F.min,
        "first": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), order_key)),
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), order_key)),
    }
    fold = {
        "sum": F.sum,
        "count": F.sum,
        "max": F.max,
        "min": F.min,
        "first": lambda v: F.first(v, ignorenulls=True),
        "last": lambda v: F.last(v, ignorenulls=True),
    }
    within = {**fold, "count": F.count}
    prefix = _prefix(rows, keys)
    parts = rows.groupBy(*keys, BUCKET).agg(
        *[partial[kind](name).alias(f"_p{name}") for kind, name in zip(kinds, values)]
    )
    parts = parts.select(
        *keys,
        BUCKET,
        *[fold[kind](f"_p{name}").over(prefix).alias(f"_o{name}") for kind, name in zip(kinds, values)],
    )
    inner = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*_cols(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = rows.select(
        "*", *[within[kind](name).over(inner).alias(f"_i{name}") for kind, name in zip(kinds, values)]
    )
    joined = _attach(scanned, parts, keys)

    def combine(kind: str, name: str) -> Column:
        before, here = F.col(f"_o{name}"), F.col(f"_i{name}")
        if kind in ("sum", "count"):
            return F.coalesce(before + here, here, before)
        if kind == "max":
            return F.greatest(before, here)
        if kind == "min":
            return F.least(before, here)
        return F.coalesce(before, here) if kind == "first" else F.coalesce(here, before)

    result = [
        combine(kind, name).alias(out) for out, kind, name in zip(outputs, kinds, values)
    ]
    return joined.select(*_cols(df.columns), *result)


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, Column],
    buckets: int | None = None,
) -> DataFrame:
    """The values of the next row by ``order`` within ``keys`` (null on the last row)."""
    rows = with_bucket(
        df.withColumn("_next", F.struct(*[c.alias(n) for n, c in outputs.items()])), keys, order, buckets
    )
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    parts = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.min_by("_next", F.struct(*_cols(order))).alias("_head"))
        .withColumn("_after", F.lead("_head").over(window.orderBy(BUCKET)))
        .drop("_head")
    )
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*_cols(order))
    led = rows.withColumn("_led", F.lead("_next").over(inner))
    merged = _attach(led, parts, keys).withColumn("_pick", F.coalesce("_led", "_after"))
    return merged.select(*_cols(df.columns), *[F.col(f"_pick.{n}").alias(n) for n in outputs])


def value_at_mass(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: Column,
    target,
    name: str,
    buckets: int | None = None,
) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``target(total)``; else the largest value.

    Equal values are added up before anything is ordered, so a value held by a third of all rows
    is one row here.
    """
    mass = df.groupBy(*keys, value).agg(F.sum(weight).alias("_mass"))
    totals = mass.groupBy(*keys).agg(F.sum("_mass").alias("_total"), F.max(value).alias("_top"))
    scan = running(mass, keys, [value], {"_cum": ("sum", F.col("_mass"))}, buckets=buckets)
    if keys:
        joined = scan.join(totals, list(keys))
    else:
        joined = scan.withColumn("_t", totals.select(F.struct("_total", "_top")).scalar()).select("*", "_t.*")
    reached = F.when(F.col("_cum") >= target(F.col("_total")), F.col(value))
    return joined.groupBy(*keys).agg(F.coalesce(F.min(reached), F.max("_top")).alias(name))


def quantile_round(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Nearest-rank quantile at 0-based index round-half-even(q * (n - 1))."""
    rank = lambda n: F.bround(F.lit(q) * (n - 1), 0) + 1
    kept = df.filter(F.col(value).isNotNull())
    return value_at_mass(kept, keys, value, F.lit(1), rank, name)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], groups: Callable[[DataFrame], DataFrame], names: Sequence[str]
) -> DataFrame:
    """``quantile_round`` for several quantiles and for overlapping groups of the cells named by ``keys``.

    ``groups`` turns rows of cells into rows of their groups, named by ``names``. Counts per cell and bucket tell which bucket
    holds a rank; only rows of those buckets are moved, counted by value and put in order, so no row is copied to its groups.
    """
    given = df.select(*keys, value).filter(F.col(value).isNotNull())
    # A few bounds as constants: a search in generated code costs a row less than one by array functions.
    bounds = given.select(_bounds(given, [], [value], FEW_BUCKETS).alias("a")).limit(1).collect()
    bounds = sorted({b[value] for b in bounds[0].a}) if bounds else []

    def place(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(value) < bounds[middle], place(low, middle)).otherwise(place(middle + 1, high))

    rows = given.withColumn(BUCKET, place(0, len(bounds)))
    sizes = groups(rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_rows"))).groupBy(*names, BUCKET).agg(F.sum("_rows").alias("_rows"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(_prefix(sizes, names)), F.lit(0)))
    sizes = sizes.withColumn("_total", F.sum("_rows").over(Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(q)).alias("_q")) for n, q in quantiles.items()]))
    wanted = sizes.select("*", asked.alias("_a")).select("*", "_a.*")
    wanted = wanted.withColumn("_rank", F.bround(F.col("_q") * (F.col("_total") - 1), 0) + 1 - F.col("_before"))
    wanted = cut_lineage(wanted.filter((F.col("_rank") > 0) & (F.col("_rank") <= F.col("_rows"))).select(*names, BUCKET, "_name", "_rank"))
    held = [r[0] for r in wanted.select(BUCKET).distinct().collect()]
    near = rows.filter(F.col(BUCKET).isin(held)).groupBy(*keys, BUCKET, value).agg(F.count(F.lit(1)).alias("_rows"))
    same = [F.col(n).eqNullSafe(F.col(f"_w{n}")) for n in (*names, BUCKET)]
    met = groups(near).join(wanted.withColumnsRenamed({n: f"_w{n}" for n in (*names, BUCKET)}), all_of(same))
    mass = met.groupBy(*names, "_name", value).agg(F.sum("_rows").alias("_rows"), F.first("_rank").alias("_rank"))
    upto = Window.partitionBy(*names, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = mass.withColumn("_cum", F.sum("_rows").over(upto)).filter(F.col("_cum") >= F.col("_rank"))
    figure = lambda n: F.min(F.when(F.col("_name") == n, F.col(value))).alias(n)
    return found.groupBy(*names).agg(*[figure(n) for n in quantiles])


def quantile_ceil(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Nearest-rank quantile at 0-based index max(0, ceil(q * n) - 1)."""
    rank = lambda n: F.greatest(F.lit(1), F.ceil(F.lit(q) * n))
    kept = df.filter(F.col(value).isNotNull())
    return value_at_mass(kept, keys, value, F.lit(1), rank, name)


def weighted_quantile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, q: Column | float, name: str
) -> DataFrame:
    """Smallest value with cumulative weight >= q * total weight."""
    fraction = q if isinstance(q, Column) else F.lit(q)
    return value_at_mass(df, keys, value, F.col(weight), lambda total: fraction * total, name)


def shards(df: DataFrame, count: int, order: Sequence[str], name: str = "shard") -> DataFrame:
    """Split into ``count`` contiguous shards; the first ``n mod count`` get one row more."""
    ranked = positions(df, [], order, name="_pos", total="_n")
    small = F.floor(F.col("_n") / count)
    extra = F.col("_n") % count
    edge = extra * (small + 1)
    index = F.col("_pos") - 1
    shard = F.when(index < edge, F.floor(index / (small + 1))).otherwise(
        extra + F.floor((index - edge) / F.greatest(small, F.lit(1)))
    )
    checked = F.when(F.col("_n") < count, F.raise_error(F.lit("more shards than rows"))).otherwise(shard)
    return ranked.withColumn(name, checked.cast("int")).drop("_pos", "_n")


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page of the ordered rows with the total and the next offset (null at the end).

    Bucket sizes tell which buckets hold the page; only their rows are moved and ranked, however deep it is.
    """
    rows = with_bucket(df, [], order)
    sizes = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_rows"))
    parts = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(_prefix(rows, [])), F.lit(0)))
    parts = parts.filter((F.col("_offset") < offset + limit) & (F.col("_offset") + F.col("_rows") > offset))
    held = parts.agg(F.struct(F.min(BUCKET).alias("low"), F.max(BUCKET).alias("high")).alias("b"))
    near = rows.withColumn("_held", held.scalar()).filter(F.col(BUCKET).between(F.col("_held.low"), F.col("_held.high"))).drop("_held")
    inner = Window.partitionBy(BUCKET).orderBy(*_cols(order))
    ranked = _attach(near.withColumn("_rank", F.row_number().over(inner)), parts.drop("_rows"), [])
    place = F.col("_rank") + F.col("_offset")
    picked = ranked.filter((place > offset) & (place <= offset + limit)).drop("_rank", "_offset", BUCKET)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    following_offset = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("bigint"))
    return picked.withColumn("total", total.scalar()).withColumn("next_offset", following_offset).orderBy(*_cols(order))


def all_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
