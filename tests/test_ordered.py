import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteplan.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows, and one value half of them."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.66, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.5, 5.0, np.round(rng.random(n) * 100, 2))
    frame = pd.DataFrame({"key": key, "seq": rng.permutation(n), "value": value})
    return frame, spark.createDataFrame(frame)


def test_positions_running_following(skewed):
    pdf, df = skewed
    pdf = pdf.sort_values(["key", "seq"]).reset_index(drop=True)
    group = pdf.groupby("key").value
    got = ordered.positions(df, ["key"], ["seq"], total="n").toPandas().sort_values(["key", "seq"])
    assert (got.position.values == group.cumcount().values + 1).all()
    assert (got.n.values == group.transform("size").values).all()
    out = {"s": ("sum", F.col("value")), "hi": ("max", F.col("value")), "lo": ("min", F.col("value")), "first": ("first", F.col("value"))}
    got = ordered.running(df, ["key"], ["seq"], out).toPandas().sort_values(["key", "seq"])
    assert np.allclose(got.s, group.cumsum())
    assert (got.hi.values == group.cummax().values).all() and (got.lo.values == group.cummin().values).all()
    assert (got["first"].values == group.transform("first").values).all()
    got = ordered.running(df, ["key"], ["seq"], {"p": ("last", F.col("value")), "c": ("count", F.col("value"))}, inclusive=False)
    got = got.toPandas().sort_values(["key", "seq"])
    assert (got.p.fillna(-1).values == group.shift(1).fillna(-1).values).all()
    assert (got.c.values == group.cumcount().values).all()
    got = ordered.following(df, ["key"], ["seq"], {"nxt": F.col("value")}).toPandas().sort_values(["key", "seq"])
    assert (got.nxt.fillna(-1).values == group.shift(-1).fillna(-1).values).all()


def test_quantiles_over_whole_table(skewed):
    pdf, df = skewed
    values = sorted(pdf.value)
    assert ordered.quantile_round(df, [], "value", 0.95, "q").first().q == values[round(0.95 * (len(values) - 1))]
    assert ordered.quantile_ceil(df, [], "value", 0.3, "q").first().q == values[max(0, math.ceil(0.3 * len(values)) - 1)]


def test_shards_and_page(spark):
    df = spark.range(10)
    sizes = [r["count"] for r in ordered.shards(df, 4, ["id"]).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 2, 2]
    rows = ordered.page(df, ["id"], 4, 3).collect()
    assert [r.id for r in rows] == [4, 5, 6] and rows[0].total == 10 and rows[0].next_offset == 7
    assert ordered.page(df, ["id"], 8, 3).first().next_offset is None
    with pytest.raises(Exception):
        ordered.shards(df, 11, ["id"]).collect()


def test_empty_input(spark):
    df = spark.createDataFrame([], "k INT, v DOUBLE")
    assert ordered.positions(df, ["k"], ["v"]).count() == 0
    assert ordered.quantile_ceil(df, ["k"], "v", 0.5, "q").count() == 0


def test_deep_pages(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    for offset, limit in ((0, 7), (2490, 20), (4990, 50), (4999, 1), (6000, 5)):
        got = ordered.page(df, ["k"], offset, limit).collect()
        assert [r.k for r in got] == list(range(5000))[offset : offset + limit]
        assert all(r.total == 5000 and r.next_offset == (offset + limit if offset + limit < 5000 else None) for r in got)
    assert ordered.page(df.limit(0), ["k"], 0, 5).collect() == []
