"""Token tables: prompts as lists of token ids in Parquet, in order of their records."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.llm.common import id_lists
from siteplan.llm.encoder import encoder, slices

#: Files up to this many have their places sent to every task; more are joined by a shuffle.
PLACED_FILES = 1_000_000


def write_token_table(
    prompts: DataFrame, folder: str, tokenizer: str, end_id: int, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10
) -> None:
    """Encode ``record_id, prompt`` of case records and write a token table, one row per record.

    Columns written: ``record_id``, ``file_no``, ``file_start`` (ids of earlier records of the same file),
    ``n_tokens``, ``token_ids``. Rows are ranged and sorted by record id, then by a hash of the prompt and the
    prompt, so files follow each other in that order and row-group and page statistics on ``record_id`` narrow
    a selective read. ``token_ids`` is dictionary encoded (a vocabulary fits one dictionary page), the sorted
    and running columns are delta encoded, and the writer adds page indexes. ``row_group_bytes`` and
    ``page_bytes`` bound what a reader must hold or skip.

    A null prompt is empty and yields the end id alone. A null record id sorts first. Repeated rows are
    written as often as they come. An empty input writes an empty table. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, file_no, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                offsets, ids = one.encode_column(batch.column(1).slice(lo, hi - lo), end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, file_no, "i4")), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets).astype("i4")), id_lists(offsets, ids)],
                    names=["record_id", "file_no", "file_start", "n_tokens", "token_ids"],
                )
                start += int(offsets[-1])

    prompts = prompts.select("record_id", "prompt")
    order = ["record_id", F.xxhash64("prompt"), "prompt"]
    kind = prompts.schema["record_id"].dataType.simpleString()
    (
        prompts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        .mapInArrow(encode, f"record_id {kind}, file_no int, file_start long, n_tokens int, token_ids array<int>")
        .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#record_id", "false").option("parquet.enable.dictionary#file_start", "false")
        .option("compression", "snappy").parquet(folder)
    )


def read_token_table(spark: SparkSession, folder: str) -> DataFrame:
    """A token table as ``record_id, start, n_tokens, token_ids``; ``start`` counts the ids of all earlier records.

    Places of files come from their totals (one row per file); records are only scanned. A filter on
    ``record_id`` and a choice of columns reach the Parquet scan.
    """
    table = spark.read.parquet(folder)
    totals = table.groupBy("file_no").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("_n")).orderBy("file_no").collect()
    placed = list(zip((r["file_no"] for r in totals), accumulate((r["_n"] for r in totals), initial=0), strict=False))
    places = spark.createDataFrame(placed, "file_no int, _before long")
    places = F.broadcast(places) if len(placed) <= PLACED_FILES else places
    return table.join(places, "file_no").select("record_id", (F.col("_before") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "token_ids")
