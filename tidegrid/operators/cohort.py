"""Data density, gaps and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.compat import second_diff


def density(df: DataFrame, entity: str, ts: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """first/last, active_days (at least 1), readings and readings per day for each name -> kind."""
    counts = [F.count(F.when(F.col(kind) == k, 1)).alias(f"{n}_readings") for n, k in kinds.items()]
    out = df.where(F.col(ts).isNotNull()).groupBy(entity).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), *counts)
    out = out.withColumn("active_days", F.greatest(second_diff("first_at", "last_at") / F.lit(86400.0) + 1, F.lit(1.0)))
    return out.withColumns({f"{n}_per_day": F.col(f"{n}_readings") / F.col("active_days") for n in kinds})


def dense_enough(df: DataFrame, least: dict[str, float]) -> DataFrame:
    for n, x in least.items():
        df = df.where(F.col(f"{n}_per_day") >= x)
    return df


def gap_metrics(df: DataFrame, entity: str, ts: str, long_gap_hours: float = 0.5) -> DataFrame:
    """Per entity with two rows or more: rows, long gaps, longest gap, hours with data over hours in all."""
    w = W.partitionBy(entity).orderBy(ts)
    gaps = df.where(F.col(ts).isNotNull()).withColumn("_gap", second_diff(F.lag(ts).over(w), F.col(ts)) / F.lit(3600.0))
    out = gaps.groupBy(entity).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_gap") > long_gap_hours, 1)).alias("long_gaps"), F.max("_gap").alias("max_gap_hours"),
        F.countDistinct(F.date_trunc("hour", F.col(ts))).alias("hours_with_data"), F.greatest(second_diff(F.min(ts), F.max(ts)) / F.lit(3600.0), F.lit(1.0)).alias("total_hours"),
    )
    return out.where("n >= 2").withColumn("density", F.col("hours_with_data") / F.col("total_hours"))


def sampling_audit(df: DataFrame, entity: str, ts: str, kind: str) -> DataFrame:
    """Per kind: median and 90th percentile of minutes between an entity's readings."""
    w = W.partitionBy(entity, kind).orderBy(ts)
    gaps = df.withColumn("_gap", second_diff(F.lag(ts).over(w), F.col(ts)) / F.lit(60.0)).where("_gap IS NOT NULL")
    return gaps.groupBy(kind).agg(F.percentile("_gap", 0.5).alias("median_minutes"), F.percentile("_gap", 0.9).alias("p90_minutes"))


def cutoff_sweep(df: DataFrame, value: str, weight: str, cutoffs: list[float]) -> DataFrame:
    """Per cutoff: entities and weight kept (value > cutoff) and lost; one pass over the entities."""
    aggs = []
    for i, c in enumerate(cutoffs):
        aggs += [F.count(F.when(F.col(value) > c, 1)).alias(f"k{i}"), F.sum(F.when(F.col(value) > c, F.col(weight)).otherwise(0)).alias(f"w{i}")]
    row = df.agg(F.count("*").alias("n"), F.sum(weight).alias("w"), *aggs)
    parts = [F.struct(F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("kept"), (F.col("n") - F.col(f"k{i}")).alias("lost"), F.col(f"w{i}").alias("kept_weight"), (F.col("w") - F.col(f"w{i}")).alias("lost_weight")) for i, c in enumerate(cutoffs)]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def gold(first: DataFrame, second: DataFrame, entity: str) -> DataFrame:
    """Ids in either set, with where they come from."""
    a = first.select(entity).distinct().withColumn("_a", F.lit(1))
    b = second.select(entity).distinct().withColumn("_b", F.lit(1))
    origin = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "first only").otherwise("second only")
    return a.join(b, entity, "full").select(entity, origin.alias("origin"))


def dense_before(events: DataFrame, readings: DataFrame, entity: str, event_ts: str, ts: str, row: str, hours: int = 6, least: float = 0.8, slots_per_hour: int = 12) -> DataFrame:
    """Entities with an event before which, in [t - hours, t), more than least of the slots hold a reading.

    Events and readings are united and read in one window pass per entity, so that nothing multiplies.
    """
    width = 3600 // slots_per_hour
    slots = readings.select(entity, F.col(ts).alias("_t"), F.lit(None).cast("long").alias("_e"), (F.unix_seconds(F.col(ts).cast("timestamp")) / width).cast("long").alias("_s"))
    marks = events.where(F.col(event_ts).isNotNull()).select(entity, F.col(event_ts).alias("_t"), F.col(row).cast("long").alias("_e"), F.lit(None).cast("long").alias("_s"))
    frame = f"OVER (PARTITION BY {entity} ORDER BY _t RANGE BETWEEN INTERVAL '{hours // 24} {hours % 24}:00:00.000000' DAY TO SECOND PRECEDING AND INTERVAL '0 0:00:00.000001' DAY TO SECOND PRECEDING)"
    seen = slots.unionByName(marks).select(entity, "_e", F.expr(f"size(collect_set(_s) {frame})").alias("n"))
    return seen.where(F.col("_e").isNotNull() & (F.col("n") / F.lit(float(hours * slots_per_hour)) > least)).select(entity).distinct()
