"""Removal of boilerplate lines that many sites share.

A line's spread is the number of distinct sites that hold it. HyperLogLog sketches of the sites are built
per line hash with partial merging before the shuffle, so a line of a third of all rows costs one sketch per
task. Lines whose estimate lies near the threshold get an exact distinct count; only lines at or above the
threshold are removed, wherever they stand. Where keep_in names an id column, each such line stays in one place: at its
first position in the document of the lowest id that holds it with a site (rows that repeat this id keep it, too).

Lines are what stands between newline characters. Lines shorter than min_chars characters stay, and so do
lines of null sites as regards counting (a null site counts for no spread). A null text stays null, an empty
one empty, and a document whose every line goes keeps an empty text. Repeated rows are cleaned row by row;
further columns are kept as they are, n_chars included (see clean_lines). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh_name, lean, ship, stage

#: Boilerplate hashes up to this number (8 bytes each) are broadcast; more are joined by salted shuffles.
BROADCAST_LINES = 1 << 17
SALTS = 64


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 20, lg_k: int = 12, keep_in: str | None = None) -> DataFrame:
    """line_hash, sites, home: the hash (xxhash64) of every line that min_sites sites or more hold; home is its lowest keep_in, where that is given."""
    own = [F.col(keep_in).alias("_id")] if keep_in else []
    home = ["home"] if keep_in else []
    lines = docs.select(F.col(site_col).cast("string").alias("_site"), *own, F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("_line"))
    lines = lines.where((F.length("_line") >= min_chars) & F.col("_site").isNotNull()).select(F.xxhash64("_line").alias("line_hash"), "_site", *(["_id"] if keep_in else []))
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", lg_k)).alias("est"), *([F.min("_id").alias("home")] if keep_in else []))
    error = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    judged = stage(spread.where(F.col("est") >= min_sites - error), "line-spread")
    near = judged.where(F.col("est") <= min_sites + error).select("line_hash", *home)
    exact = lines.join(near, "line_hash", "left_semi").groupBy("line_hash", "_site").agg(F.lit(1).alias("_one")).groupBy("line_hash").agg(F.count("*").alias("sites")).join(near, "line_hash")
    sure = judged.where(F.col("est") > min_sites + error).select("line_hash", F.col("est").cast("long").alias("sites"), *home)
    return stage(sure.unionByName(exact.where(F.col("sites") >= min_sites)), "line-boilerplate")


def _cleaner(known, min_chars: int, text_at: int, id_at: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, homes = known.value
        bad = set(found.tolist()) if id_at is None else dict(zip(found.tolist(), homes, strict=True))
        for b in batches:
            texts, totals, removed = [], [], []
            ids = [None] * b.num_rows if id_at is None else b.column(id_at).to_pylist()
            for t, own in zip(b.column(text_at).to_pylist(), ids, strict=True):
                if t is None:
                    texts.append(None), totals.append(0), removed.append(0)
                    continue
                lines = t.split("\n")
                kept, here = [], set()
                for x in lines:
                    if len(x) >= min_chars and (h := xxhash.xxh64_intdigest(x.encode(), 42)) in bad:
                        if id_at is None or bad[h] != own or h in here:
                            continue
                        here.add(h)
                    kept.append(x)
                texts.append(t if len(kept) == len(lines) else "\n".join(kept))
                totals.append(len(lines)), removed.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int32()), pa.array(removed, pa.int32())], names=[*b.schema.names, "n_lines", "n_removed"])

    return lean(run)


def _joined(docs: DataFrame, bad: DataFrame, text_col: str, min_chars: int, keep_in: str | None = None) -> DataFrame:
    """For a boilerplate set without a small bound: lines are matched by (hash, salt), and each document gets its own bad hashes."""
    row, gone, home = (fresh_name(docs, n) for n in ("_row", "_bad", "_home"))
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    own = F.col(keep_in) if keep_in else F.lit(None)
    lines = rows.select(F.col(row).alias("_r"), own.alias("_own"), F.explode(F.array_distinct(F.split(F.col(text_col).cast("string"), "\n"))).alias("_line"))
    lines = lines.where(F.length("_line") >= min_chars).select("_r", "_own", F.xxhash64("_line").alias("line_hash"), F.pmod(F.xxhash64("_r"), F.lit(SALTS)).alias("_salt"))
    at_home = F.col("home").eqNullSafe(F.col("_own")) if keep_in else F.lit(False)
    salted = bad.select(*bad.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    hits = lines.join(salted, ["line_hash", "_salt"]).groupBy(F.col("_r").alias(row)).agg(F.collect_set(F.when(~at_home, F.col("line_hash"))).alias(gone), F.collect_set(F.when(at_home, F.col("line_hash"))).alias(home))
    all_lines = F.split(F.col(text_col).cast("string"), "\n")
    again = lambda x, i: F.array_contains(F.col(home), F.xxhash64(x)) & (F.array_position(all_lines, x) <= i)
    kept = F.filter(all_lines, lambda x, i: (F.length(x) < min_chars) | ~(F.array_contains(F.col(gone), F.xxhash64(x)) | again(x, i)))
    out = rows.join(hits, row, "left")
    return out.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)).alias("n_removed"),
    )


def clean_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 20, lg_k: int = 12, broadcast_lines: int = BROADCAST_LINES, keep_in: str | None = None) -> DataFrame:
    """All columns of docs with the text cleaned, plus n_lines and n_removed (which replace columns of these names)."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    bad = boilerplate(docs, text_col, site_col, min_sites, min_chars, lg_k, keep_in)
    if bad.limit(broadcast_lines + 1).count() > broadcast_lines:
        return _joined(docs, bad, text_col, min_chars, keep_in)
    known = bad.drop("sites").toArrow()  # at most broadcast_lines rows
    found = known.column("line_hash").to_numpy().astype(np.int64).view(np.uint64), known.column("home").to_pylist() if keep_in else None
    ship(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    return docs.mapInArrow(_cleaner(spark.sparkContext.broadcast(found), min_chars, docs.columns.index(text_col), docs.columns.index(keep_in) if keep_in else None), schema)
