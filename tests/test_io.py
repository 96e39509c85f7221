import sqlite3
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import readers, sinks
from tidegrid.streaming import events


def test_sqlite_and_npy(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE m (id INTEGER PRIMARY KEY, v REAL, n TEXT)")
        con.executemany("INSERT INTO m VALUES (?, ?, ?)", [(i, i / 2, None if i % 3 else "x") for i in range(1, 101)])
        con.execute("CREATE TABLE e (id INTEGER)")
    df = readers.read_sqlite(spark, db, "m", "id long, v double, n string", 4)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.count("*"), F.sum("v"), F.count("n")).first() == (100, 2525.0, 33)
    assert readers.read_sqlite(spark, db, "e", "id long").count() == 0
    np.save(tmp_path / "a.npy", np.arange(24, dtype=np.float32).reshape(4, 3, 2))
    rows = readers.read_npy(spark, str(tmp_path / "a.npy")).orderBy("i").collect()
    assert len(rows) == 4 and rows[1]["shape"] == [3, 2] and rows[1]["values"] == [6.0, 7.0, 8.0, 9.0, 10.0, 11.0]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n2,\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, x double").collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "a.json"), "a int").count() == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    assert sinks.publish(df, path) is None
    sinks.upsert_table(spark, path, spark.createDataFrame([(2, 1, "c"), (3, 1, "d")], "k int, t int, v string"), ["k"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]
    assert len(list(tmp_path.glob("t.bak-*"))) == 1
    sinks.write_sorted(df, str(tmp_path / "s"), "k", "t")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    done = []
    assert sinks.run_once(spark, str(tmp_path / "mark.json"), lambda: done.append(1)) and not sinks.run_once(spark, str(tmp_path / "mark.json"), lambda: done.append(2))
    assert done == [1] and "done_at" in sinks.read_manifest(spark, str(tmp_path / "mark.json"))
    splits = spark.createDataFrame([(1, "train"), (2, "val")], "k int, split string")
    sinks.write_splits(df, splits, "k", str(tmp_path / "sp"), {"seed": 42})
    assert sinks.read_manifest(spark, str(tmp_path / "sp.manifest.json")) == {"seed": 42, "splits": {"train": 1, "val": 1}}
    with pytest.raises(ValueError, match="without a split"):
        sinks.write_splits(df, splits.where("k = 1"), "k", str(tmp_path / "sq"), {})


def test_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(1, i, t0 + timedelta(seconds=s)) for i, s in enumerate([0, 480, 960, 2000, 90_000])]
    src = spark.createDataFrame(rows, "e int, id int, t timestamp_ntz")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = events.zoned(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "t")
        q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = run(lambda s: events.stream_buckets(s, "e", "t", "1 hour", "10 minutes", [F.count("*").alias("n")]), "buckets")
    assert [r["n"] for r in got] == [4]  # the last bucket is still open
    got = run(lambda s: events.stream_bursts(s, "e", "t", "id", 600, "10 minutes"), "bursts")
    assert sorted(r["id"] for r in got) == [0, 3, 4]
