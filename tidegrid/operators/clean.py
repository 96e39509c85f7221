"""Cleaning of raw readings and demographics. Column names are parameters; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Plausible ranges of readings; above drop_above a reading is void, not clipped.
RANGES = {"Heartrate": (30, 220), "Temperature": (30, None), "Saturation": (50, None), "Steps": (0, 50_000)}
DROP_ABOVE = {"Temperature": 45}
PAIR_RANGES = {"sbp": (70, 250), "dbp": (40, 140)}


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by order."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_mean(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per exact key; values are averaged, nulls ignored."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rounded(value: Column, kind: Column, one_place: tuple[str, ...] = ("Temperature",)) -> Column:
    """One decimal for some kinds, none for the others; halves away from zero."""
    return F.when(kind.isin(*one_place), F.round(value, 1)).otherwise(F.round(value, 0))


def _limited(value: Column, low, high) -> Column:
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(float(high))).otherwise(out)
    return out


def clipped(value: Column, kind: Column, ranges=None, drop_above=None) -> Column:
    """Value limited to the range of its kind; void above drop_above; kinds without a range pass."""
    ranges, drop_above = ranges or RANGES, DROP_ABOVE if drop_above is None else drop_above
    out = value
    for name, (low, high) in ranges.items():
        own = _limited(value, low, high)
        if name in drop_above:
            own = F.when(value > drop_above[name], F.lit(None)).otherwise(own)
        out = F.when(kind == name, own).otherwise(out)
    return out


def clean_readings(df: DataFrame, kind: str = "type", value: str = "value", high: str = "sbp", low: str = "dbp", pair_kind: str = "BloodPressure", least_gap: float = 10) -> DataFrame:
    """Rounds, clips, voids inverted pairs, and adds the guarded difference pulse_pressure."""
    k = F.col(kind)
    df = df.withColumn(value, clipped(rounded(F.col(value), k), k))
    for c in (high, low):
        lo, hi = PAIR_RANGES["sbp" if c == high else "dbp"]
        r = F.round(F.col(c), 0)
        df = df.withColumn(c, F.when(k == pair_kind, _limited(r, lo, hi)).otherwise(r))
    inverted = F.col(low) >= F.col(high)
    df = df.withColumn("_inv", F.coalesce(inverted, F.lit(False)))
    df = df.withColumn(high, F.when(~F.col("_inv"), F.col(high))).withColumn(low, F.when(~F.col("_inv"), F.col(low))).drop("_inv")
    gap = F.col(high) - F.col(low)
    return df.withColumn("pulse_pressure", F.when(gap >= least_gap, gap))


def reconcile_people(df: DataFrame, year: int, low: int = 60, high: int = 110, age: str = "age", born: str = "birthdate", gender: str = "gender") -> DataFrame:
    """Age filter, 'Unknown' gender to null, birthdate over a stated age that is off by more than a year, mutual imputation."""
    df = df.where(F.col(age).between(low, high)).withColumn(gender, F.nullif(F.col(gender), F.lit("Unknown")))
    df = df.where(~(F.col(age).isNull() & F.col(born).isNull()))
    told = F.lit(year) - F.year(born)
    df = df.withColumn(age, F.when(F.col(born).isNotNull() & (F.abs(told - F.col(age)) > 1), told).otherwise(F.coalesce(F.col(age), told)))
    return df.withColumn(born, F.coalesce(F.col(born), F.make_date(F.lit(year) - F.col(age), F.lit(1), F.lit(1))))


def gender_code(gender: Column, unknown: int | None = None) -> Column:
    """1 for names in k or f, 0 for m, else unknown."""
    g = F.lower(gender)
    return F.when(g.like("k%") | g.like("f%"), 1).when(g.like("m%"), 0).otherwise(F.lit(unknown))


def split_names(df: DataFrame, names: str, alias: str) -> DataFrame:
    """A row per trimmed, non-empty entry of a comma list."""
    parts = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(alias, F.explode(parts)).drop(names)


def surrogate_keys(df: DataFrame, name: str, order: str) -> DataFrame:
    """id, name: one row per name folded by A-Z only; ids by first appearance, first spelling wins."""
    fold = F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = df.where(F.col(name).isNotNull()).groupBy(fold.alias("folded")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("m"))
    ranked = first.withColumn("id", F.row_number().over(W.orderBy("m.o", "m.n")))  # distinct names only
    return ranked.select("id", "folded", F.col("m.n").alias(name))


def universe(tables: list[tuple[DataFrame, str]], name: str = "id") -> DataFrame:
    """Distinct ids over several tables."""
    out = tables[0][0].select(F.col(tables[0][1]).alias(name))
    for df, c in tables[1:]:
        out = out.unionByName(df.select(F.col(c).alias(name)))
    return out.where(F.col(name).isNotNull()).distinct()


def insert_missing(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """df and the rows of more whose keys df lacks."""
    return df.unionByName(more.join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of more in place of those of the same keys."""
    return df.join(more.select(*keys), keys, "left_anti").unionByName(more, allowMissingColumns=True)


def known_parents(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def cap(value: Column, high: float) -> Column:
    """Value limited from above; null stays null."""
    return F.when(value > high, F.lit(high)).otherwise(value)


def fill_both_ways(df: DataFrame, entity: str, ts: str, columns: list[str]) -> DataFrame:
    """Per entity: forward fill, then backward fill, then 0."""
    back = W.partitionBy(entity).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(entity).orderBy(ts).rowsBetween(0, W.unboundedFollowing)
    return df.select("*", *[F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.lit(0)).alias(f"_{c}") for c in columns]).drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def forward_fill(df: DataFrame, entity: str, ts: str, columns: list[str], limit: int) -> DataFrame:
    """Forward fill over at most limit rows of a gap-free grid."""
    w = W.partitionBy(entity).orderBy(ts).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})
