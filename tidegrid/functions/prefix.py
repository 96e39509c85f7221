"""Ranks and running sums over a whole table without a one-task window.

Rows are dealt to buckets in the order asked for; every bucket sums its own rows, one row per bucket gives what lies
before it, and that small table is broadcast. A bucket is a function of the row, so a task that runs again deals alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 256


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """df with, for each name -> column, the column's sum up to the row and (name_all) over all rows, by the columns by.

    Buckets must rise with order. The rows of a bucket are one task's; (by, bucket) pairs are broadcast.
    """
    by = by or []
    rows = df.withColumn("_bk", bucket)
    totals = rows.groupBy(*by, "_bk").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    base = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bk").alias("_at"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_all") for k in sums],
    )
    here = W.partitionBy(*by, "_bk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(c).over(here).alias(f"_o_{k}") for k, c in sums.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_bk") == F.col("_at")]
    out = own.join(F.broadcast(base), same)  # one row per bucket (and value of by)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[x for k in sums for x in ((F.col(f"_o_{k}") + F.col(f"_b_{k}")).alias(k), F.col(f"{k}_all"))])


def key_bucket(key: Column) -> Column:
    """Buckets of a key of hexadecimal digits, such as md5: its first three digits."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def value_bucket(df: DataFrame, column: str, descending: bool = False) -> Column:
    """Buckets of about equal numbers of rows by a numeric column, from its quantiles (at most BUCKETS numbers)."""
    bounds = sorted(set(df.approxQuantile(column, [i / BUCKETS for i in range(1, BUCKETS)], 0.002)))
    x = F.col(column).cast("double")
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: (b > x) if descending else (b <= x))) if bounds else F.lit(0)
    return F.coalesce(at, F.lit(0)).cast("int")


def ranked(df: DataFrame, by: list[str], key: Column, *ties: str) -> DataFrame:
    """df with _rank (from 1, in the order of a hexadecimal key, then ties) and _rank_all (rows) within the columns by."""
    marked = df.withColumn("_key", key).withColumn("_one", F.lit(1).cast("long"))
    return running(marked, key_bucket(F.col("_key")), [F.col("_key"), *map(F.col, ties)], {"_rank": "_one"}, by).drop("_key", "_one")
