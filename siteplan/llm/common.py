"""Helpers shared by the operators: staged tables, connected components, checksums."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows are computed once, survive lost executors, and later reads see one fixed result even where
    ``df`` depends on partition numbers. The files stay until the folder is cleared.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``a, b``: one row ``node, root`` per linked node, root = least node.

    Alternates large-star and small-star steps until the links are stars. Each round is two joins over the
    links that are left, staged in the shared folder; links that are stars already need none.
    Null ends and self links are ignored; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    links = stage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _are_stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        links = stage(moved.union(least.select("u", F.col("_m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, which is no ``u`` itself."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where(F.col("up") + F.col("down") > 1).isEmpty()


def with_crc32(df: DataFrame, ids: str, name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the unsigned CRC-32 of token ids as little-endian unsigned 32-bit integers.

    ``ids`` is a column of integer lists or of such bytes.
    """
    schema = df.select(*keep).schema.add(name, "long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            if pa.types.is_binary(column.type):
                crc = [zlib.crc32(x.as_buffer()) for x in column]
            else:
                offsets = column.offsets.to_numpy()
                raw = memoryview(column.values.to_numpy(zero_copy_only=False)).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(crc, pa.int64())], names=[*keep, name])

    return df.select(*keep, ids).mapInArrow(digest, schema)


def id_lists(offsets: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Token ids as one Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(ids.view("<i4")))


def id_bytes(offsets: np.ndarray, ids: np.ndarray) -> pa.BinaryArray:
    """Token ids as one Arrow column of bytes."""
    ends = pa.py_buffer((4 * offsets).astype("<i4"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
