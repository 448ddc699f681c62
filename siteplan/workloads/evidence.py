"""Cleaning, profiling, health measures and id rules over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteplan.operators import evidence, health, ordered, quality
from siteplan.workloads import query
from siteplan.workloads.base import DEMAND, demand, table, with_sql

MARKED_SQL = """marked AS (SELECT d.*, CASE WHEN demand_id % 7 = 0 THEN ' S ' WHEN demand_id % 7 = 1 THEN 'Suppressed' WHEN demand_id % 7 = 2 THEN 'ok' END AS note,
  demand_id % 10 = 3 AS hidden, CASE WHEN demand_id % 13 = 0 THEN NULL ELSE need END AS want, CASE WHEN demand_id % 17 = 0 THEN NULL ELSE grp END AS grp2 FROM demand d)"""
FLAG = "(coalesce(lower(trim(note)) IN ('s', 'suppressed', '*', 'true'), false) OR coalesce(hidden, false))"


def _marked(spark, sf):
    k = F.col("demand_id")
    return demand(spark, sf).withColumns({
        "note": F.when(k % 7 == 0, " S ").when(k % 7 == 1, "Suppressed").when(k % 7 == 2, "ok"), "hidden": k % 10 == 3,
        "want": F.when(k % 13 != 0, F.col("need")), "grp2": F.when(k % 17 != 0, F.col("grp")),
    })


@query("suppression_flags", with_sql(DEMAND, MARKED_SQL, body=f"SELECT demand_id, {FLAG} AS suppressed FROM marked"))
def suppression_flags(spark, sf):
    rows = _marked(spark, sf)
    return rows.select("demand_id", quality.suppressed(rows, ["note", "hidden"]).alias("suppressed"))


@query(
    "demand_without_missing",
    with_sql(DEMAND, MARKED_SQL, body=f"SELECT CAST(demand_id AS VARCHAR) AS demand_id, want, grp2, {FLAG} AS is_suppressed FROM marked WHERE {FLAG} OR (want IS NOT NULL AND grp2 IS NOT NULL)"),
)
def demand_without_missing(spark, sf):
    """Canonical demand, rows with missing unsuppressed dimensions dropped."""
    rows = evidence.build_demand(_marked(spark, sf), "demand_id", ["want"], ["grp2"], suppression=["note", "hidden"], policy="drop")
    return rows.select("demand_id", "want", "grp2", "is_suppressed")


@query(
    "demand_with_zeros",
    with_sql(DEMAND, MARKED_SQL, body=f"SELECT CAST(demand_id AS VARCHAR) AS demand_id, coalesce(want, 0.0) AS want, {FLAG} AS is_suppressed FROM marked"),
)
def demand_with_zeros(spark, sf):
    rows = evidence.build_demand(_marked(spark, sf), "demand_id", ["want"], suppression=["note", "hidden"], policy="zero")
    return rows.select("demand_id", "want", "is_suppressed")


@query(
    "line_id_report",
    """SELECT CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS null_ids, CAST(count(id) - count(DISTINCT id) AS BIGINT) AS duplicate_ids
FROM (SELECT CASE WHEN l_linenumber < 7 THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS id FROM lineitem)""",
)
def line_id_report(spark, sf):
    name = F.when(F.col("l_linenumber") < 7, F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return quality.id_report(table(spark, sf, "lineitem").select(name.alias("id")), "id")


@query(
    "numeric_report",
    """WITH t AS (SELECT 'size' AS field, CAST(p_size AS VARCHAR) AS raw FROM part UNION ALL SELECT 'mixed', CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 5 = 1 THEN NULL WHEN p_partkey % 5 = 2 THEN '-' || CAST(p_size AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END FROM part)
SELECT field, count(*) FILTER (WHERE raw IS NULL) AS missing, count(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS DOUBLE) IS NULL) AS unreadable, 0::BIGINT AS not_finite, count(*) FILTER (WHERE TRY_CAST(raw AS DOUBLE) < 0) AS negative FROM t GROUP BY 1""",
)
def numeric_report(spark, sf):
    k = F.col("p_partkey")
    mixed = F.when(k % 5 == 0, F.col("p_type")).when(k % 5 == 1, None).when(k % 5 == 2, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_retailprice").cast("string"))
    return quality.numeric_report(table(spark, sf, "part").select(F.col("p_size").alias("size"), mixed.alias("mixed")), ["size", "mixed"])


@query(
    "order_profile",
    """WITH t AS (SELECT o_custkey % 50 AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS c, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_custkey % 20 AS DOUBLE) END AS x, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS DOUBLE) END AS y FROM orders)
SELECT count(*) AS row_count, round(sum((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) / (3.0::DOUBLE * count(*)), 9) AS missing_fraction, count(*) FILTER (WHERE x IS NULL) AS empty_geometry_count,
  count(*) FILTER (WHERE lower(b) = 's') AS suppressed_count, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM t GROUP BY a, b, c, x, y)) AS duplicate_count,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM t WHERE x IS NOT NULL GROUP BY x, y)) AS duplicate_geometry_count FROM t""",
)
def order_profile(spark, sf):
    """Quality profile with missing cells, equal rows and equal points."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("a"), F.col("o_orderstatus").alias("b"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("c"),
        F.when(k % 8 != 0, (F.col("o_custkey") % 20).cast("double")).alias("x"), F.when(k % 8 != 0, (F.col("o_custkey") % 7).cast("double")).alias("y"),
    )
    return quality.profile(rows, ["b"], ["x", "y"]).drop("warnings").withColumn("missing_fraction", F.round("missing_fraction", 9))


@query(
    "document_quality",
    """WITH t AS (SELECT text, lang, source FROM documents)
SELECT round(0.0, 9)::DOUBLE AS missing_fraction, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM t GROUP BY text, lang, source)) AS duplicate_count""",
)
def document_quality(spark, sf):
    """Repeated whole documents within a language and source."""
    return quality.quality_summary(table(spark, sf, "documents").select("text", "lang", "source"))


@query(
    "observed_period",
    """SELECT CAST(least(min(o_orderdate), (SELECT min(l_shipdate) FROM lineitem)) AS TIMESTAMP) AS start, CAST(greatest(max(o_orderdate), (SELECT max(l_shipdate) FROM lineitem)) AS TIMESTAMP) AS "end" FROM orders""",
)
def observed_period(spark, sf):
    """Earliest and latest instant over order and shipping dates."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "full_outer")
    found = quality.temporal_extent(joined, ["o_orderdate", "l_shipdate"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query(
    "normalized_parts",
    """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'part-' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), 6, '0') ELSE p_name END AS base, p_retailprice FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS VARCHAR) END AS id, k > 1 AS repeated, round(p_retailprice * 1000, 4) AS p_retailprice FROM k""",
)
def normalized_parts(spark, sf):
    """Stable ids from repeated and blank names, and scaled prices."""
    name = F.when(F.col("p_partkey") % 17 == 0, "  ").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("raw"), "p_retailprice")
    found = evidence.normalize(rows, ["p_partkey"], source_id="raw", prefix="part", value_fields=["p_retailprice"], factor=1000.0)
    return found.select("p_partkey", "id", F.col("_repeat").alias("repeated"), F.round("p_retailprice", 4).alias("p_retailprice"))


RATE_SQL = """area AS (SELECT p_brand AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS cases, count(*) AS population,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS c1, count(*) FILTER (WHERE l_linestatus = 'F') AS n1,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS c2, count(*) FILTER (WHERE l_linestatus = 'O') AS n2
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
Z = "1.959963984540054"


def areas(spark, sf):
    """Returned lines per brand as cases, all lines as population, line status as the age band."""
    returned = F.col("l_returnflag") == "R"
    done, open_ = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("p_brand").alias("id")).agg(
        F.count_if(returned).alias("cases"), F.count(F.lit(1)).alias("population"), F.count_if(returned & done).alias("c1"), F.count_if(done).alias("n1"),
        F.count_if(returned & open_).alias("c2"), F.count_if(open_).alias("n2"),
    )


def _rounded(df, *names):
    return df.select("id", *[F.round(n, 6).alias(n) for n in names], "measure_suppressed")


BOUNDS = ("measure", "measure_standard_error", "measure_lower", "measure_upper")


def _bounds_sql(source: str) -> str:
    return f"""SELECT id, round(CASE WHEN NOT h THEN m END, 6) AS measure, round(CASE WHEN NOT h THEN se END, 6) AS measure_standard_error,
  round(CASE WHEN NOT h THEN greatest(m - {Z} * se, 0.0) END, 6) AS measure_lower, round(CASE WHEN NOT h THEN m + {Z} * se END, 6) AS measure_upper, h AS measure_suppressed FROM {source}"""


@query("brand_counts", with_sql(RATE_SQL, "m AS (SELECT id, cases::DOUBLE AS m, sqrt(cases) AS se, cases < 790 AS h FROM area)", body=_bounds_sql("m")))
def brand_counts(spark, sf):
    return _rounded(health.health_count(areas(spark, sf), "cases", threshold=790, confidence=0.95), *BOUNDS)


@query(
    "brand_rates",
    with_sql(RATE_SQL, "m AS (SELECT id, cases / population * 1000.0 AS m, sqrt(cases / population * (1 - cases / population) / population) * 1000 AS se, cases < 790 AS h FROM area)", body=_bounds_sql("m")),
)
def brand_rates(spark, sf):
    return _rounded(health.health_rate(areas(spark, sf), "cases", "population", 1000.0, threshold=790, confidence=0.95), *BOUNDS)


@query(
    "brand_standardized_rates",
    with_sql(
        RATE_SQL,
        """m AS (SELECT id, (0.3 * c1 / n1 + 0.7 * c2 / n2) * 1000 AS m, sqrt(0.09 * (c1 / n1) * (1 - c1 / n1) / n1 + 0.49 * (c2 / n2) * (1 - c2 / n2) / n2) * 1000 AS se, c1 < 395 OR c2 < 395 AS h FROM area)""",
        body=_bounds_sql("m"),
    ),
)
def brand_standardized_rates(spark, sf):
    found = health.derive_health_measure(
        areas(spark, sf), "age_standardized_rate", strata=[("c1", "n1", 3.0), ("c2", "n2", 7.0)], scale=1000.0, threshold=395, confidence=0.95
    )
    return _rounded(found, *BOUNDS)


@query(
    "weighted_price_quantile",
    """WITH c AS (SELECT l_returnflag, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT l_returnflag, min(l_extendedprice) FILTER (WHERE cum >= 0.75 * t) AS price FROM c GROUP BY 1""",
)
def weighted_price_quantile(spark, sf):
    """Three keys hold all lines, so each key's order is cut into ranges."""
    return ordered.weighted_quantile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.75, "price")


@query(
    "nearest_rank_quantiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS rounded, min(value) FILTER (WHERE i = greatest(0, CAST(ceil(0.5 * n) AS BIGINT) - 1)) AS ceiled FROM r GROUP BY 1""",
)
def nearest_rank_quantiles(spark, sf):
    """The two nearest-rank rules, per event type."""
    rows = table(spark, sf, "events")
    a = ordered.quantile_round(rows, ["event_type"], "value", 0.95, "rounded")
    return a.join(ordered.quantile_ceil(rows, ["event_type"], "value", 0.5, "ceiled"), "event_type")


@query(
    "document_shards",
    "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents",
)
def document_shards(spark, sf):
    return ordered.shards(table(spark, sf, "documents"), 7, ["doc_id"]).select("doc_id", "shard")


@query(
    "order_page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, CASE WHEN (SELECT count(*) FROM orders) > 120 THEN 120::BIGINT END AS next_offset FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 100""",
)
def order_page(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordered.page(rows, ["o_totalprice", "o_orderkey"], 100, 20)


@query(
    "suitable_parts",
    "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO')",
)
def suitable_parts(spark, sf):
    return quality.filter_suitable(table(spark, sf, "part"), "p_type", ["ECONOMY", "PROMO"]).select("p_partkey")


@query(
    "unpivoted_lines",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS row_id, col_id, value
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, UNNEST(['l_quantity', 'l_discount', 'l_tax']) AS col_id, UNNEST([l_quantity, l_discount, l_tax]) AS value FROM lineitem)""",
)
def unpivoted_lines(spark, sf):
    from siteplan.sources.readers import wide_to_long

    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return wide_to_long(table(spark, sf, "lineitem").withColumn("row_id", key), "row_id", ["l_quantity", "l_discount", "l_tax"])


@query(
    "embedding_cells",
    """WITH e AS (SELECT vec_id, UNNEST(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT vec_id, 'r' AS row_id, 'c' || CAST(j AS VARCHAR) AS col_id, 0 AS row_ord, CAST(j AS INT) AS col_ord, CAST(v AS DOUBLE) AS value FROM e""",
)
def embedding_cells(spark, sf):
    """Dense labelled matrices to long form: one matrix per embedding."""
    from siteplan.sources.readers import dense_to_long

    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.array(F.lit("r")).alias("row_ids"), F.transform("embedding", lambda v, i: F.concat(F.lit("c"), i.cast("string"))).alias("column_ids"),
        F.array(F.col("embedding").cast("array<double>")).alias("values"),
    )
    return dense_to_long(rows)


@query(
    "folded_lines",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + l_discount + l_tax, 6) AS added, round(l_quantity - l_discount - l_tax, 6) AS subtracted, round(l_quantity * l_discount * l_tax, 6) AS multiplied, round(l_extendedprice / l_quantity / 3, 9) AS divided FROM lineitem",
)
def folded_lines(spark, sf):
    from siteplan.functions.text import fold_numbers

    three = F.array("l_quantity", "l_discount", "l_tax")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(
        *keys, F.round(fold_numbers("add", three), 6).alias("added"), F.round(fold_numbers("subtract", three), 6).alias("subtracted"),
        F.round(fold_numbers("multiply", three), 6).alias("multiplied"),
        F.round(fold_numbers("divide", F.array(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(3.0))), 9).alias("divided"),
    )


@query(
    "cost_estimates",
    """SELECT o_orderkey AS id, round(5.0 + coalesce(0.5 * sum(l_quantity), 0) + coalesce(0.001 * sum(l_extendedprice), 0), 6) AS estimate FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def cost_estimates(spark, sf):
    """Linear cost model over long-form features of each order; a feature without weight counts nothing."""
    from siteplan.operators.evaluation import estimate_cost

    entry = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("value"))
    long = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.explode(F.array(entry("quantity", F.col("l_quantity")), entry("price", F.col("l_extendedprice")), entry("tax", F.col("l_tax")))).alias("e")
    ).select("id", "e.*")
    weights = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(w).alias("weight")) for n, w in (("base", 5.0), ("quantity", 0.5), ("price", 0.001))])
    model = spark.range(1).select(F.explode(weights).alias("e")).select("e.*")
    return estimate_cost(long, model, "id").withColumn("estimate", F.round("estimate", 6))
