"""Scans: typed CSV, Parquet, JSON, SQLite, NumPy and Excel. Schemas are given, never inferred."""

from __future__ import annotations

import ast
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """One table from one or many paths; only the named columns reach the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables()))


def columns_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path, self.table = schema.fieldNames(), options["path"], options["table"]
        self.parts = int(options.get("partitions", 8))
        if not all(n.replace("_", "").isalnum() for n in [*self.columns, self.table]):
            raise ValueError("names of columns and tables may hold letters, digits and underscores")

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format('sqlite_file').schema(...).option('table', t).load(path): row-id ranges in parallel, read-only.

    The file must be on storage that the executors share.
    """

    @classmethod
    def name(cls):
        return "sqlite_file"

    def schema(self):
        raise ValueError("give a schema")

    def reader(self, schema):
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType | str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").schema(schema).option("table", table).option("partitions", partitions).load(path)


def _npy(data: bytes) -> np.ndarray:
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a NumPy file")
    size, at = (struct.unpack_from("<H", data, 8)[0], 10) if data[6] == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    head = ast.literal_eval(data[at : at + size].decode())
    out = np.frombuffer(data, np.dtype(head["descr"]), offset=at + size)
    return out.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, i, shape, values: a row per first index of each file, the rest flattened as array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = _npy(data)
                for k in range(0, len(a), 1024):
                    part = a[k : k + 1024]
                    flat = part.reshape(len(part), -1).astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array([list(a.shape[1:])] * len(part), pa.list_(pa.int64())), pa.array(list(flat), pa.list_(pa.float64()))],
                        names=["path", "i", "shape", "values"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, i long, shape array<long>, values array<double>")


def read_workbook(spark: SparkSession, paths: list[str], columns: list[str], schema: str, skip_prefix: str = "_") -> DataFrame:
    """All sheets of Excel files but those with the prefix; columns by position, bad numbers and dates to null. Needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading Excel files needs openpyxl") from e
    names = StructType.fromDDL(schema).fieldNames() if hasattr(StructType, "fromDDL") else columns

    def rows(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                book = openpyxl.load_workbook(path, read_only=True, data_only=True)
                for sheet in book.worksheets:
                    if sheet.title.startswith(skip_prefix):
                        continue
                    values = [[None if v is None else str(v) for v in (*r[: len(columns)], *[None] * (len(columns) - len(r)))] for r in sheet.iter_rows(min_row=2, values_only=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([sheet.title] * len(values)), *(pa.array([r[k] for r in values], pa.string()) for k in range(len(columns)))], names=["sheet", *columns])

    raw = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(rows, "sheet string, " + ", ".join(f"{c} string" for c in columns))
    types = dict(zip(names, [f.dataType for f in StructType.fromDDL(schema).fields], strict=True))
    return raw.select("sheet", *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in columns])
