"""Shared plumbing: tables in the cluster's shared folder, distinct sets of ids as bounded Bloom bits."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of one Arrow batch between Spark and Python, in place of Spark's default of 64 MB.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2MB"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where none is set and all runs in one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidegrid-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    gc.collect()  # the driver, too, gives back what a step has left
    _give_back()
    _driver_gives_back(spark)
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing lazy refers to any more."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Readies a session for Arrow functions: this package on every executor's path, and batches of BATCH at most.

    The bound is one for all functions, so that it does not matter which of them was called last; a session that sets
    a bound of its own keeps it. It only limits memory, never results.
    """
    if spark.conf.get(BATCH_KEY, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        spark.conf.set(BATCH_KEY, BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_tidegrid_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="tidegrid-ship-")) / "tidegrid.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._tidegrid_shipped = True


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or with underscores in front until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lean(run):
    """run, an Arrow function, giving the memory that it has freed back to the system now and then, and at its end.

    Idle Python workers live on beside the next stage's, so what they keep counts against the executor.
    """

    def leaner(batches):
        for k, out in enumerate(run(batches)):
            yield out
            del out
            if k % 16 == 15:
                _give_back()
        _give_back()

    return leaner


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _driver_gives_back(spark: SparkSession) -> None:
    """The same for the driver's JVM: what compiler, codecs and buffers have freed stays in the C library's heaps otherwise.

    A heap grown beyond six tenths of its bound is collected first, after which the JVM shrinks it, and Spark's cleaner
    drops the shuffles and broadcasts that nothing refers to. JVMs without the command for trimming keep what they hold.
    """
    java = spark._jvm.java.lang
    heap = java.Runtime.getRuntime()
    if heap.totalMemory() > 0.6 * heap.maxMemory():
        java.System.gc()
    gateway = spark.sparkContext._gateway
    kinds, values = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    try:
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = java.Class.forName(name)
        values[0], values[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
