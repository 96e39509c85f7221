"""Window statistics, normalisation and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

STATS = {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}


def flatten(df: DataFrame, sample: list[str], order: str, dynamic: list[str], static: list[str]) -> DataFrame:
    """One row per sample: {feature}_{stat} by statistic, then the first value of each static feature; nulls are ignored."""
    cols = [f(c).alias(f"{c}_{s}") for s, f in STATS.items() for c in dynamic]
    firsts = [F.min_by(F.struct(c), order)[c].alias(c) for c in static]
    return df.groupBy(*sample).agg(*cols, *firsts)


def active(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Rows where some column is present and not zero."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.abs(F.col(c)) > least, F.lit(False))
    return df.where(test)


def norm_stats(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """feature, mean, std (population; 1 where it vanishes) in one pass."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < least, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def normalise(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the training rows' statistics; missing values take the mean."""
    row = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(row)).withColumns(z).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])  # one row


def median_impute(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the exact median of the training rows."""
    row = train.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(row)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def first_per_entity(df: DataFrame, entity: str, ts: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(entity).orderBy(ts))).where("_rn = 1").drop("_rn")


def dummies(df: DataFrame, column: str, values: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns {column}_{value} in sorted order of values."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in sorted(values)[int(drop_first) :]]).drop(column)


def group_features(columns: list[str], static: list[str], circadian: list[str]) -> dict[str, list[str]]:
    return {"dynamic": [c for c in columns if c not in static and c not in circadian], "static": [c for c in columns if c in static], "circadian": [c for c in columns if c in circadian]}


def feature_columns(columns: list[str], excluded: list[str]) -> list[str]:
    return [c for c in columns if c not in excluded]


def without_patterns(columns: list[str], patterns: list[str]) -> list[str]:
    """Columns whose name holds none of the patterns."""
    return [c for c in columns if not any(p in c for p in patterns)]


def reconstruction_error(df: DataFrame, actual: str, predicted: str, name: str = "error") -> DataFrame:
    """Mean squared difference of two arrays."""
    sq = F.zip_with(actual, predicted, lambda a, b: (a - b) * (a - b))
    return df.withColumn(name, F.try_divide(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x), F.size(actual)))
