"""Fixed-length windows, splits and balanced samples. Windows never cross entities; sums are prefix sums, not rescans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.compat import order_key
from ..functions.prefix import ranked


def indexed(df: DataFrame, entity: str, ts: str, abnormal: Column) -> DataFrame:
    """Adds pos (from 0), rows (of the entity) and bad (abnormal rows so far, this one included)."""
    w = W.partitionBy(entity).orderBy(ts)
    x = df.withColumn("_abn", F.when(abnormal, 1).otherwise(0))
    return x.select("*", (F.row_number().over(w) - 1).alias("pos"), F.sum("_abn").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("bad"), F.count("*").over(W.partitionBy(entity)).alias("rows")).drop("_abn")


def normal_starts(df: DataFrame, entity: str, ts: str, seq_len: int, stride: int) -> DataFrame:
    """Starts 0, stride, ... whose seq_len rows are all normal. df is from indexed()."""
    w = W.partitionBy(entity).orderBy(ts)
    x = df.withColumn("_end", F.lead("bad", seq_len - 1).over(w)).withColumn("_before", F.coalesce(F.lag("bad", 1).over(w), F.lit(0)))
    return x.where((F.col("pos") % stride == 0) & (F.col("_end") == F.col("_before"))).drop("_end", "_before")


def targets(df: DataFrame, entity: str, ts: str, seq_len: int, positive: Column) -> DataFrame:
    """Rows after seq_len normal rows that are positive (label 1; the row itself is outside its window), and every seq_len-th row that is normal itself (label 0)."""
    w = W.partitionBy(entity).orderBy(ts)
    x = df.withColumn("_prev", F.lag("bad", 1).over(w)).withColumn("_start", F.coalesce(F.lag("bad", seq_len + 1).over(w), F.lit(0)))
    x = x.where(F.col("pos") >= seq_len)
    pure, clean = F.col("_prev") == F.col("_start"), F.col("bad") == F.col("_start")
    label = F.when(pure & positive, 1).when(clean & (F.col("pos") % seq_len == 0), 0)
    return x.withColumn("label", label).where("label IS NOT NULL").drop("_prev", "_start")


def window_values(df: DataFrame, entity: str, ts: str, columns: list[str], seq_len: int) -> Column:
    """The seq_len rows before a row as array<struct>, oldest first; nulls inside stay."""
    return F.collect_list(F.struct(*columns)).over(W.partitionBy(entity).orderBy(ts).rowsBetween(-seq_len, -1))


def horizon_severity(df: DataFrame, entity: str, ts: str, seq_len: int, stride: int, levels: list[str]) -> DataFrame:
    """Window starts at a stride with the highest level in the seq_len rows after the window; levels from mild to severe."""
    w = W.partitionBy(entity).orderBy(ts)
    level = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) * (i + 1) for i, c in enumerate(levels)], F.lit(0))
    x = df.withColumn("_lv", level).withColumn("severity", F.max("_lv").over(w.rowsBetween(seq_len, 2 * seq_len - 1)))
    return x.where((F.col("pos") % stride == 0) & (F.col("pos") + 2 * seq_len <= F.col("rows"))).drop("_lv")


def sample_n(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in the reproducible random order of keys."""
    return df.orderBy(order_key(seed, *keys), *keys).limit(n)


def balanced(df: DataFrame, label: str, seed: int, *keys: str) -> DataFrame:
    """As many rows of label 0 as of label 1: the smaller class whole, the other by random order."""
    x = ranked(df.where(F.col(label).isin(0, 1)), [label], order_key(seed, *keys), *keys)
    n = df.where(F.col(label).isin(0, 1)).groupBy(label).count().agg(F.when(F.count("*") == 2, F.min("count")).otherwise(0).alias("_n"))
    return x.crossJoin(F.broadcast(n)).where("_rank <= _n").drop("_rank", "_rank_all", "_n")  # n is one row


def balanced_first(df: DataFrame, label: str, order: list[str], seed: int, *keys: str) -> DataFrame:
    """The first n rows of label 1 by order, and n rows of label 0 by random order; n is the smaller class. Both stay in order."""
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    n = min(pos.count(), neg.count())
    return pos.orderBy(*order).limit(n).unionByName(neg.orderBy(order_key(seed, *keys), *keys).limit(n))


def mixed_train(df: DataFrame, label: str, entity: str, seed: int, *keys: str) -> DataFrame:
    """A balanced sample whose rows of label 0 come from entities with rows of label 1 only; ValueError if one class is empty."""
    own = df.where(F.col(label) == 1).select(entity).distinct()
    x = df.where(F.col(label).isin(0, 1)).join(own, entity, "left_semi")
    found = {r[label] for r in x.select(label).distinct().collect()}
    if found != {0, 1}:
        raise ValueError("no windows of label " + ", ".join(str(k) for k in (0, 1) if k not in found))
    return balanced(x, label, seed, *keys)


def without_history(df: DataFrame, entity: str, levels: list[str]) -> DataFrame:
    """The rows of entities in which none of the level columns is ever above 0."""
    seen = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in levels])
    return df.join(df.where(seen).select(entity).distinct(), entity, "left_anti")


def downsample(df: DataFrame, label: str, ratio: int, seed: int, *keys: str) -> DataFrame:
    """All rows of label 1 and at most ratio times as many of label 0."""
    n = df.agg((F.count(F.when(F.col(label) == 1, 1)) * ratio).alias("_n"))
    x = ranked(df, [label], order_key(seed, *keys), *keys)
    return x.crossJoin(F.broadcast(n)).where((F.col(label) == 1) | (F.col("_rank") <= F.col("_n"))).drop("_rank", "_rank_all", "_n")


def per_entity_limit(df: DataFrame, entity: str, n: int, seed: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(entity).orderBy(order_key(seed, *keys), *keys))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def reserved_split(entities: DataFrame, entity: str, actionable: str, seed: int, val_n: int, test_n: int, share: float, short_ok: bool = False) -> DataFrame:
    """split of each entity: the first val_n actionable to val, the next test_n to test; of the others share each; the rest train.

    ValueError if there are fewer than val_n + test_n actionable entities, unless short_ok.
    """
    x = entities.select(entity, F.col(actionable).cast("int").alias(actionable))
    if not short_ok and (n := x.where(F.col(actionable) == 1).limit(val_n + test_n).count()) < val_n + test_n:
        raise ValueError(f"too few actionable entities: {n} of {val_n + test_n}")
    x = ranked(x, [actionable], order_key(seed, entity), entity).withColumnsRenamed({"_rank": "_r", "_rank_all": "_n"})
    cut = F.floor(F.col("_n") * share)
    name = (
        F.when((F.col(actionable) == 1) & (F.col("_r") <= val_n), "val").when((F.col(actionable) == 1) & (F.col("_r") <= val_n + test_n), "test")
        .when((F.col(actionable) == 0) & (F.col("_r") <= cut), "val").when((F.col(actionable) == 0) & (F.col("_r") <= 2 * cut), "test").otherwise("train")
    )
    return x.select(entity, actionable, name.alias("split"))


def share_split(entities: DataFrame, entity: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """split by shares of the reproducible random order; the last name takes the rest."""
    x = ranked(entities.select(entity).distinct(), [], order_key(seed, entity), entity).withColumnsRenamed({"_rank": "_r", "_rank_all": "_n"})
    done, name, names = 0.0, None, list(shares)
    for k in names[:-1]:
        done += shares[k]
        test = F.col("_r") <= F.floor(F.col("_n") * F.lit(round(done, 12)))
        name = F.when(test, k) if name is None else name.when(test, k)
    return x.select(entity, name.otherwise(names[-1]).alias("split"))


def check_disjoint(splits: dict[str, DataFrame], entity: str) -> None:
    """Raises ValueError ('split leakage ...') if an entity is in two splits; names ten at most."""
    marked = reduce(DataFrame.unionByName, [df.select(entity).distinct().withColumn("_s", F.lit(k)) for k, df in splits.items()])
    twice = marked.groupBy(entity).agg(F.sort_array(F.collect_set("_s")).alias("s")).where(F.size("s") > 1).orderBy(entity).limit(10).collect()
    if twice:
        raise ValueError("split leakage: " + "; ".join(f"{r[0]} in {', '.join(r['s'])}" for r in twice))
