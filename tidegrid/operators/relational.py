"""Shares, top rows, set operations and aligned joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def value_share(df: DataFrame, column: str) -> DataFrame:
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def pivot_counts(df: DataFrame, row: str, column: str, values: list, prefix: str) -> DataFrame:
    """Counts per row value with a fixed column list, absent pairs 0."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"{prefix}{v}".replace("-", "m")) for v in values])


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def full_outer_by_kind(df: DataFrame, keys: list[str], kind: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """Means of several kinds (name -> kind) side by side, in one conditional pass instead of chained full joins."""
    out = df.groupBy(*keys).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(n) for n, k in kinds.items()])
    some = F.lit(False)
    for n in kinds:
        some = some | F.col(n).isNotNull()
    return out.where(some)


def set_table(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of union, intersection and both differences of two id sets."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    parts = {"union": x.union(y).distinct(), "intersect": x.intersect(y), "a_minus_b": x.subtract(y), "b_minus_a": y.subtract(x)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("id_sum"))
        out = row if out is None else out.unionByName(row)
    return out


def reindexed(df: DataFrame, keys: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """A row for each key of keys, in place of df's own set of keys; what is missing takes its fill value."""
    return keys.select(key).distinct().join(df, key, "left").fillna(fill)


def full_row_dedup(df: DataFrame) -> DataFrame:
    """Each distinct row once; nulls equal nulls."""
    return df.distinct()


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of like, in its order and types; columns that df lacks are null, further ones go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])
