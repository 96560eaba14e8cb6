"""Documents encoded in ascending doc_id order, shard by shard.

Rows are dealt by ranges of doc_id and sorted within each, so a shard is a
contiguous run of the whole order and only one total per shard is needed to
place every document: a two-pass prefix sum. Rows that repeat a doc_id stay
separate rows, ordered by their text; a null doc_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.bpe import encoder
from scanlode.llm.common import partial_sums

#: Documents that are encoded at a time.
SLICE = 512


def by_doc_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and ids (16 bits each, closed by ``end``) of up to ``SLICE`` rows at a time."""
    own, tail = encoder(vocabulary), end.to_bytes(2, "little")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).to_pylist(), [x + tail for x in own.ids(part.column(1).to_pylist())]


def shard() -> int:
    return TaskContext.get().partitionId()


def with_starts(rows: DataFrame, length: str) -> DataFrame:
    """Adds ``shard_start``, the total of ``length`` in all shards before; one row per shard is broadcast."""
    totals = rows.groupBy("shard").agg(F.sum(length).alias("n")).withColumn("all", F.lit(0))
    starts = partial_sums(totals, ["all"], "shard", "n", "shard_start").select(F.col("shard").alias("of_shard"), "shard_start")
    # As many rows as there are shards (tasks of one stage), 16 bytes each.
    return rows.join(F.broadcast(starts), F.col("shard") == F.col("of_shard")).drop("of_shard")
