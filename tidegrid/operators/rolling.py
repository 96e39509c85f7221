"""Rolling statistics, slopes, recency timers and lagged correlation over per-entity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions.compat import epoch, minute_diff


def _range(agg: str, entity: str, ts: str, back: str) -> Column:
    return F.expr(f"{agg} OVER (PARTITION BY {entity} ORDER BY {ts} RANGE BETWEEN INTERVAL {back} PRECEDING AND CURRENT ROW)")


def range_std(value: str, entity: str, ts: str, back: str) -> Column:
    """Sample deviation over the time range; null for a single reading."""
    return _range(f"stddev_samp({value})", entity, ts, back)


def range_sum(value: str, entity: str, ts: str, back: str) -> Column:
    return _range(f"sum(coalesce({value}, 0))", entity, ts, back)


def range_slope(df: DataFrame, value: str, entity: str, ts: str, back: str, name: str) -> DataFrame:
    """Adds the least-squares slope of value per second over the time range; null below two readings."""
    return df.withColumn("_x", epoch(ts)).withColumn(name, _range(f"regr_slope({value}, _x)", entity, ts, back)).drop("_x")


def rows_spec(entity: str, ts: str, n: int) -> WindowSpec:
    return W.partitionBy(entity).orderBy(ts).rowsBetween(-(n - 1), 0)


def range_sum_before(value: str, entity: str, ts: str, hours: int) -> Column:
    """The sum over [t - hours, t), the row itself left out; null without readings."""
    return F.expr(f"sum({value}) OVER (PARTITION BY {entity} ORDER BY {ts} RANGE BETWEEN INTERVAL '{hours // 24} {hours % 24}:00:00.000000' DAY TO SECOND PRECEDING AND INTERVAL '0 0:00:00.000001' DAY TO SECOND PRECEDING)")


def row_frame(aggregate: Column, entity: str, ts: str, n: int) -> Column:
    """An aggregate over the last n rows, this one included."""
    return aggregate.over(rows_spec(entity, ts, n))


def rows_slope(df: DataFrame, value: str, entity: str, ts: str, n: int, name: str) -> DataFrame:
    """Slope per row over the last n rows, from two readings on."""
    w = rows_spec(entity, ts, n)
    x = df.withColumn("_x", F.row_number().over(W.partitionBy(entity).orderBy(ts)))
    return x.withColumn(name, F.when(F.count(value).over(w) >= 2, F.regr_slope(F.col(value), F.col("_x").cast("double")).over(w))).drop("_x")


def since_last(latest: dict[str, str], entity: str, ts: str, clamp_zero: bool = False) -> dict[str, Column]:
    """Minutes from the latest reading so far to ts, for each name -> latest-timestamp column; one window for all."""
    w = W.partitionBy(entity).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for name, column in latest.items():
        d = minute_diff(F.max(column).over(w), F.col(ts))
        out[name] = F.greatest(d, F.lit(0)) if clamp_zero else d
    return out


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over pairs where both are present; null where undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def lag_correlation(df: DataFrame, x: str, y: str, entity: str, ts: str, lags: range, least: int = 30) -> DataFrame:
    """lag, n, r: correlation of x with y that many rows later in the same entity; 0 for at most least pairs."""
    w = W.partitionBy(entity).orderBy(ts)
    shifted = df.select(F.col(x).alias("_x"), *[F.lead(y, k).over(w).alias(f"_y{k}") for k in lags])
    n = lambda k: F.count(F.when(F.col("_x").isNotNull() & F.col(f"_y{k}").isNotNull(), 1))
    row = shifted.agg(*[n(k).alias(f"n{k}") for k in lags], *[correlation("_x", f"_y{k}").alias(f"r{k}") for k in lags])
    stack = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{k}").alias("n"), F.when(F.col(f"n{k}") > least, F.col(f"r{k}")).otherwise(0.0).alias("r")) for k in lags])
    return row.select(F.explode(stack).alias("s")).select("s.*")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("s")).select("s.*")


def as_of(left: DataFrame, right: DataFrame, entity: str, ts: str, values: list[str]) -> DataFrame:
    """left with the latest values of right at or before its ts, by one sort instead of a join."""
    both = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side"))
    other = right.select(entity, ts, *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    w = W.partitionBy(entity).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.unionByName(other, allowMissingColumns=True).withColumns({v: F.last(f"_{v}", True).over(w) for v in values})
    return filled.where("_side = 1").drop("_side", *[f"_{v}" for v in values])
