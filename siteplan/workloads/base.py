"""Planning tables derived from the benchmark tables, in Spark and, as WITH clauses, in SQL.

Coordinates come from integer arithmetic on the keys, so both engines get the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICE_KM = 500.0
REACH_KM = 1500.0


_READ: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Scan of one table; the schema is read from the footer once per session."""
    key = (id(spark), f"{sf}/{name}.parquet")
    if key not in _READ or _READ[key].sparkSession is not spark:
        _READ[key] = spark.read.parquet(key[1])
    return _READ[key]


def _lon(key: Column, factor: int) -> Column:
    return ((key * factor) % 36000).cast("double") / 100 - 180


def _lat(key: Column, factor: int) -> Column:
    return ((key * factor) % 17000).cast("double") / 100 - 85


def demand(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("demand_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("need"), F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").alias("nation"), _lon(key, 7919).alias("lon"), _lat(key, 104729).alias("lat"),
    )


def site(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    eligible = key % 11 != 0
    return table(spark, sf, "supplier").select(
        key.alias("site_id"), F.col("s_nationkey").alias("nation"), _lon(key, 6007).alias("lon"), _lat(key, 15485863).alias("lat"),
        (key % 10 + 1).cast("double").alias("opening_cost"), (key % 7 * 500 + 1000).cast("double").alias("capacity"),
        eligible.alias("eligible"), (eligible & (key % 5 == 0)).alias("existing"),
    )


def zone(spark: SparkSession, sf: str) -> DataFrame:
    """One box per nation, 5 by 5 over the globe."""
    k = F.col("n_nationkey")
    west, south = (k % 5) * 72.0 - 180, F.floor(k / 5) * 34.0 - 85
    return table(spark, sf, "nation").select(
        k.alias("zone_id"), F.col("n_regionkey").alias("region"), west.alias("west"), south.alias("south"),
        (west + 72).alias("east"), (south + 34).alias("north"),
    )


DEMAND = """demand AS (
  SELECT c_custkey AS demand_id, greatest(c_acctbal, 0.0) AS need, c_mktsegment AS grp, c_nationkey AS nation,
    CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 104729) % 17000 AS DOUBLE) / 100 - 85 AS lat
  FROM customer)"""
SITE = """site AS (
  SELECT s_suppkey AS site_id, s_nationkey AS nation,
    CAST((s_suppkey * 6007) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((s_suppkey * 15485863) % 17000 AS DOUBLE) / 100 - 85 AS lat,
    CAST(s_suppkey % 10 + 1 AS DOUBLE) AS opening_cost, CAST(s_suppkey % 7 * 500 + 1000 AS DOUBLE) AS capacity,
    s_suppkey % 11 <> 0 AS eligible, s_suppkey % 11 <> 0 AND s_suppkey % 5 = 0 AS existing
  FROM supplier)"""
ZONE = """zone AS (
  SELECT n_nationkey AS zone_id, n_regionkey AS region, (n_nationkey % 5) * 72.0::DOUBLE - 180 AS west, (n_nationkey // 5) * 34.0::DOUBLE - 85 AS south,
    (n_nationkey % 5) * 72.0::DOUBLE - 108 AS east, (n_nationkey // 5) * 34.0::DOUBLE - 51 AS north
  FROM nation)"""


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    chord = (
        f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    )
    return f"(2 * 6371.0088 * asin(sqrt(least(greatest({chord}, 0.0), 1.0))))"


def pairs_sql(km: float, name: str = "pair") -> str:
    """All demand/site pairs within a distance, by brute force."""
    d = haversine_sql("d.lon", "d.lat", "s.lon", "s.lat")
    return f"""{name} AS (
  SELECT * FROM (SELECT d.demand_id, s.site_id, {d} AS km FROM demand d CROSS JOIN site s) WHERE km <= {km})"""


def with_sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def od_pairs(spark: SparkSession, sf: str, km: float) -> DataFrame:
    from siteplan.operators.access import pairs_within_sphere

    o = demand(spark, sf).select("demand_id", F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    d = site(spark, sf).select("site_id", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"))
    return pairs_within_sphere(o, d, km).select("demand_id", "site_id", F.col("distance_km").alias("km"))
