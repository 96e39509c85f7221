"""Sinks: sorted Parquet, atomic publication, upserts on plain tables, manifests and job marks."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import upsert


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def write_sorted(df: DataFrame, path: str, entity: str, ts: str, mode: str = "overwrite") -> None:
    """Zstandard Parquet, range-partitioned by entity and sorted inside, so that row groups prune by entity and time."""
    ordered = df.repartitionByRange(entity).sortWithinPartitions(entity, ts)
    ordered.write.mode(mode).option("compression", "zstd").parquet(path)


def publish(df: DataFrame, path: str, keep_backup: bool = True) -> str | None:
    """Writes beside path, then swaps by rename; gives the old output's new place. Readers never see half a table."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(fresh)
    at, fs = _fs(spark, path)
    backup = None
    if fs.exists(at):
        backup = f"{path.rstrip('/')}.bak-{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:6]}"
        fs.rename(at, _fs(spark, backup)[0])
    if not fs.rename(_fs(spark, fresh)[0], at):
        raise OSError(f"could not publish {path}")
    if backup and not keep_backup:
        fs.delete(_fs(spark, backup)[0], True)
    return backup


def upsert_table(spark: SparkSession, path: str, more: DataFrame, keys: list[str]) -> None:
    """Replaces the rows of the same keys in a Parquet table, or creates it."""
    old = spark.read.parquet(path) if exists(spark, path) else None
    publish(more if old is None else upsert(old, more, keys), path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One small JSON document."""
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(content, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_splits(df: DataFrame, splits: DataFrame, entity: str, path: str, policy: dict) -> None:
    """Rows by split (one folder each) and a manifest with every split's number of entities; entities without a split are an error."""
    spark = df.sparkSession
    lost = df.select(entity).distinct().join(splits, entity, "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"entities without a split: {sorted(r[0] for r in lost)}")
    df.join(splits.select(entity, "split"), entity).write.mode("overwrite").partitionBy("split").parquet(path)
    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    write_manifest(spark, f"{path.rstrip('/')}.manifest.json", {"splits": sizes, **policy})


def run_once(spark: SparkSession, mark: str, job) -> bool:
    """Runs job() unless its mark exists, then sets the mark: a restarted pipeline skips what is complete."""
    if exists(spark, mark):
        return False
    job()
    write_manifest(spark, mark, {"done_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})
    return True
