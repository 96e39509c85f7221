"""Structured Streaming forms of bucket aggregation and burst compression. Event time needs a zoned timestamp column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Casts a timestamp without zone, which watermarks reject."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_buckets(stream: DataFrame, entity: str, ts: str, width: str, late: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per entity and tumbling bucket; rows later than the watermark are dropped, closed buckets are emitted once (append mode)."""
    by = stream.withWatermark(ts, late).groupBy(entity, F.window(ts, width).alias("_w"))
    return by.agg(*aggregates).withColumn("bucket", F.col("_w.start")).drop("_w")


def stream_bursts(stream: DataFrame, entity: str, ts: str, row: str, gap_seconds: int, late: str) -> DataFrame:
    """Rows more than gap_seconds after the entity's previous row. State is one timestamp per entity, dropped once it is older than gap and watermark."""
    schema = StructType([stream.schema[entity], stream.schema[row], stream.schema[ts]])
    gap = gap_seconds * 1_000_000

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([ts, row], kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for t in [int(x.value) // 1000 for x in rows[ts]]:  # microseconds
            keep.append(last is None or t > last + gap)
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows[keep][[entity, row, ts]]

    marked = stream.withWatermark(ts, late)
    return marked.groupBy(entity).applyInPandasWithState(run, schema, StructType([StructField("last", LongType())]), "append", GroupStateTimeout.EventTimeTimeout)
