"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by id; every partition sums its own sizes, the driver adds up one total per
partition (never per row), and a row's global byte offset decides its shard: ``offset * n div total``.
Only id, size and checksum move, never a text.

Nulls: a null text has size 1 (no bytes plus one) and the checksum of no bytes; null ids come first.
Ties and repeated ids: ordered by size, then checksum; equal rows are interchangeable. Empty tables give
no rows. Further columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import ship, stage


def _local_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and each row's byte and row offset within it."""
    pid, off, idx = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = off + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(size), pid, np.int64)), pa.array(ends - size), pa.array(np.arange(idx, idx + len(size)))],
            names=["doc_id", "size", "text_crc32", "pid", "off", "idx"],
        )
        off, idx = int(ends[-1]) if len(ends) else off, idx + len(size)


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shard k holds the rows whose byte offset lies in the k-th of n equal parts.

    A shard's bytes differ from total / n by less than one row at each of its two cuts. Slots are gapless from 0.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.mapInArrow(_local_offsets, "doc_id long, size long, text_crc32 long, pid long, off long, idx long"), "shard-offsets")

    totals = placed.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("pid").collect()
    bases, byte_base, row_base = [], 0, 0
    for t in totals:
        bases.append((t["pid"], byte_base, row_base))
        byte_base, row_base = byte_base + t["bytes"], row_base + t["n"]
    if not bases:
        bases = [(0, 0, 0)]
    base = F.broadcast(spark.createDataFrame(bases, "pid long, byte_base long, row_base long"))  # one row per partition
    located = placed.join(base, "pid").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast((byte_base + off) * {n_shards} div {max(byte_base, 1)} as int)").alias("shard"),
        (F.col("row_base") + F.col("idx")).alias("row"),
    )
    first = {r["shard"]: r["row"] for r in located.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    starts = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(n_shards)])
    return located.withColumn("slot", F.col("row") - F.get(starts, F.col("shard"))).drop("row")
