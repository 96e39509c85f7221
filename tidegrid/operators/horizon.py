"""What happened before and what happens after each grid point: burden, labels, look-back profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def burden_and_labels(grid: DataFrame, events: DataFrame, entity: str, ts: str, event_ts: str, severity: str, back_hours: int = 48, ahead_hours: int = 4, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """grid with recent_event_burden (events of a level in [t - back, t)) and label_k (any of level k in (t, t + ahead]).

    Grid and events are united and read in one window pass per entity: no interval join, so nothing multiplies.
    """
    rows = grid.withColumn("_sev", F.lit(None).cast("int")).withColumn("_grid", F.lit(1))
    marks = events.where(F.col(event_ts).isNotNull()).select(F.col(entity), F.col(event_ts).alias(ts), F.col(severity).cast("int").alias("_sev"), F.lit(0).alias("_grid"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    span = lambda h: f"INTERVAL '{h // 24} {h % 24}:00:00.000000' DAY TO SECOND"
    tick = "INTERVAL '0 0:00:00.000001' DAY TO SECOND"
    over = lambda frame: f"OVER (PARTITION BY {entity} ORDER BY {ts} RANGE BETWEEN {frame})"
    levels_sql = ", ".join(map(str, levels))
    before = over(f"{span(back_hours)} PRECEDING AND {tick} PRECEDING")
    after = over(f"{tick} FOLLOWING AND {span(ahead_hours)} FOLLOWING")
    out = both.select(
        "*",
        F.expr(f"count(CASE WHEN _sev IN ({levels_sql}) THEN 1 END) {before}").alias("recent_event_burden"),
        *[F.expr(f"coalesce(max(CASE WHEN _sev = {k} THEN 1 ELSE 0 END) {after}, 0)").alias(f"label_{k}") for k in levels],
    )
    return out.where("_grid = 1").drop("_sev", "_grid")


def look_back(events: DataFrame, readings: DataFrame, entity: str, event_ts: str, ts: str, row: str, back: str, aggregates, closed: str = "right") -> DataFrame:
    """Aggregates of the readings in the interval before each event; events without readings stay.

    closed 'right' is (t - back, t], 'left' is [t - back, t).
    """
    e, r = events.alias("e"), readings.alias("r")
    start = F.col(f"e.{event_ts}") - F.expr(f"INTERVAL {back}")
    at = F.col(f"r.{ts}")
    inside = (at > start) & (at <= F.col(f"e.{event_ts}")) if closed == "right" else (at >= start) & (at < F.col(f"e.{event_ts}"))
    return e.join(r, (F.col(f"e.{entity}") == F.col(f"r.{entity}")) & inside, "left").groupBy(F.col(f"e.{row}").alias(row)).agg(*aggregates)
