"""Buckets, gap-free grids, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.compat import bucket


def bucketed(df: DataFrame, entity: str, ts: str, width: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per entity and tumbling bucket; a time without readings has no row."""
    return df.where(F.col(ts).isNotNull()).groupBy(entity, bucket(ts, width).alias("bucket")).agg(*aggregates)


def time_grid(buckets: DataFrame, entity: str, width: str, ts: str = "bucket") -> DataFrame:
    """Every bucket from each entity's first to its last."""
    ends = buckets.groupBy(entity).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.select(entity, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {width}"))).alias(ts))


def on_grid(buckets: DataFrame, entity: str, width: str, ts: str = "bucket") -> DataFrame:
    """Buckets left-joined to their grid: both sides are dealt by entity and bucket once."""
    return time_grid(buckets, entity, width, ts).join(buckets, [entity, ts], "left")


def missing_days(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Days between an entity's first and last day that have no row."""
    days = df.select(entity, F.to_date(ts).alias("day")).distinct()
    return time_grid(days, entity, "1 DAY", "day").join(days, [entity, "day"], "left_anti")


def compress_bursts(df: DataFrame, entity: str, ts: str, row: str, gap: str = "10 MINUTES") -> DataFrame:
    """Drops rows at most gap after the entity's previous row (of any kind), so that chains keep their first."""
    w = W.partitionBy(entity).orderBy(ts, row)
    kept = df.where(F.col(ts).isNotNull()).withColumn("_prev", F.lag(ts).over(w))
    return kept.where(F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + F.expr(f"INTERVAL {gap}"))).drop("_prev")


def burst_events(df: DataFrame, entity: str, ts: str, row: str, gap: str = "10 MINUTES") -> DataFrame:
    """All rows with event_no (per entity, from 1) and event_size."""
    w = W.partitionBy(entity).orderBy(ts, row)
    fresh = F.lag(ts).over(w).isNull() | (F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}"))
    marked = df.where(F.col(ts).isNotNull()).withColumn("_new", fresh.cast("int"))
    numbered = marked.withColumn("event_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return numbered.withColumn("event_size", F.count("*").over(W.partitionBy(entity, "event_no")))


def burst_summary(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """entity, events, rows, longest_minutes, ratio (rows per event) of burst_events' rows."""
    one = events.groupBy(entity, "event_no").agg(F.count("*").alias("n"), ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 6e7).alias("minutes"))
    return one.groupBy(entity).agg(F.count("*").alias("events"), F.sum("n").alias("rows"), F.max("minutes").alias("longest_minutes"), (F.sum("n") / F.count("*")).alias("ratio"))
