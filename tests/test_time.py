from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidegrid.functions.compat import dow_sunday0, minute_diff, order_key, second_diff, to_number, to_time
from tidegrid.operators import horizon, rolling, timegrid, windows

T0 = datetime(2026, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(e, i, T0 + timedelta(seconds=s) if s is not None else None) for i, (e, s) in enumerate(rows)], "e int, id int, t timestamp_ntz")


def test_burst_edges(spark):
    df = events(spark, [(1, 0), (1, 600), (1, 1201), (2, 0), (2, 480), (2, 960), (2, 1440), (3, 5), (3, 5), (3, None)])
    assert sorted(r["id"] for r in timegrid.compress_bursts(df, "e", "t", "id").collect()) == [0, 2, 3, 7]
    got = {r["id"]: (r["event_no"], r["event_size"]) for r in timegrid.burst_events(df, "e", "t", "id").collect()}
    assert got[0] == got[1] == (1, 2) and got[2] == (2, 1) and got[6] == (1, 4) and 9 not in got


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 7200)), min_size=1, max_size=25))
def test_burst_compression_is_idempotent(spark, rows):
    once = timegrid.compress_bursts(events(spark, rows), "e", "t", "id").localCheckpoint()
    assert timegrid.compress_bursts(once, "e", "t", "id").count() == once.count()


def test_grid_and_missing_days(spark):
    b = spark.createDataFrame([(1, T0), (1, T0 + timedelta(hours=3))], "e int, bucket timestamp_ntz")
    assert timegrid.on_grid(b, "e", "1 HOUR").count() == 4
    d = spark.createDataFrame([(1, T0), (1, T0 + timedelta(days=3))], "e int, t timestamp_ntz")
    assert [str(r["day"]) for r in timegrid.missing_days(d, "e", "t").orderBy("day").collect()] == ["2026-01-02", "2026-01-03"]


def test_differences_count_boundaries(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=50), T0 + timedelta(minutes=6))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(minute_diff("a", "b"), minute_diff("b", "a"), second_diff("a", "b"), dow_sunday0("a")).first()
    assert tuple(r) == (6, -6, 310, 4)


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1.5", "2026-01-01 00:00:00"), ("x", "y"), (None, None)], "n string, t string")
    assert [tuple(r) for r in df.select(to_number("n"), to_time("t")).collect()] == [(1.5, T0), (None, None), (None, None)]


def test_recency_before_bucket_and_never(spark):
    df = spark.createDataFrame([(1, T0, T0 + timedelta(minutes=3), None), (1, T0 + timedelta(minutes=10), None, None)], "e int, b timestamp_ntz, x timestamp_ntz, y timestamp_ntz")
    for clamp, want in ((False, [-3, 7]), (True, [0, 7])):
        c = rolling.since_last({"x": "x", "y": "y"}, "e", "b", clamp)
        got = df.select(c["x"].alias("p"), c["y"].alias("q")).collect()
        assert [r["p"] for r in got] == want
        assert clamp or [r["q"] for r in got] == [None, None]


def test_label_edges(spark):
    grid = spark.createDataFrame([(1, T0), (2, T0)], "e int, t timestamp_ntz")
    us, h = timedelta(microseconds=1), timedelta(hours=1)
    marks = [(T0, 2), (T0 + us, 1), (T0 + 4 * h, 3), (T0 + 4 * h + us, 2), (T0 - 48 * h, 1), (T0 - 48 * h - us, 1), (T0 - h, 0), (T0 - h, -1)]
    alarms = spark.createDataFrame([(1, t, s) for t, s in marks], "e int, at timestamp_ntz, sev int")
    got = {r["e"]: (r["recent_event_burden"], r["label_1"], r["label_2"], r["label_3"]) for r in horizon.burden_and_labels(grid, alarms, "e", "t", "at", "sev").collect()}
    assert got == {1: (1, 1, 0, 1), 2: (0, 0, 0, 0)}


def test_std_and_slope_degenerate(spark):
    df = spark.createDataFrame([(1, T0, 1.0), (1, T0 + timedelta(hours=1), None), (1, T0 + timedelta(hours=4), 3.0), (1, T0 + timedelta(hours=9), 5.0)], "e int, t timestamp_ntz, v double")
    std = [r[0] for r in df.select(rolling.range_std("v", "e", "t", "4 HOUR"), "t").orderBy("t").collect()]
    assert std[0] is None and std[1] is None and std[2] == pytest.approx(2**0.5) and std[3] is None
    slope = [r["s"] for r in rolling.range_slope(df, "v", "e", "t", "4 HOUR", "s").orderBy("t").collect()]
    assert slope[0] is None and slope[2] == pytest.approx(2 / 14400) and slope[3] is None
    rows = [r["s"] for r in rolling.rows_slope(df, "v", "e", "t", 3, "s").orderBy("t").collect()]
    assert rows[0] is None and rows[2] == pytest.approx(1.0)


def frame(spark, entity_sizes, labels, offset):
    rows = [(e, i, float(i + offset.get(e, 0)), int((e, i) in labels)) for e, n in entity_sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "e int, t int, x double, label_3 int")


@pytest.mark.parametrize("sizes,labels,offset,seq_len,window", [({1: 7, 2: 5}, {(1, 4)}, {2: 100}, 4, [0.0, 1.0, 2.0, 3.0]), ({1: 3, 2: 3}, {(2, 2)}, {2: 100}, 2, [100.0, 101.0])])
def test_windows_hold_no_target_and_no_other_entity(spark, sizes, labels, offset, seq_len, window):
    df = windows.indexed(frame(spark, sizes, labels, offset), "e", "t", F.col("label_3") == 1)
    df = df.withColumn("w", windows.window_values(df, "e", "t", ["x"], seq_len))
    got = windows.targets(df, "e", "t", seq_len, F.col("label_3") == 1).collect()
    assert sorted({r["label"] for r in got}) == [0, 1]
    assert [[x["x"] for x in r["w"]] for r in got if r["label"] == 1] == [window]


def test_window_purity_is_brute_force(spark):
    labels = {(1, 13), (1, 40), (2, 3)}
    df = windows.indexed(frame(spark, {1: 60, 2: 30, 3: 9, 4: 10}, labels, {}), "e", "t", F.col("label_3") == 1)
    got = sorted((r["e"], r["pos"]) for r in windows.normal_starts(df, "e", "t", 10, 3).collect())
    want = sorted((e, s) for e, n in {1: 60, 2: 30, 3: 9, 4: 10}.items() for s in range(0, n - 9, 3) if not any((e, k) in labels for k in range(s, s + 10)))
    assert got == want


def test_split_leakage(spark):
    df = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
    with pytest.raises(ValueError, match="split leakage.*2"):
        windows.check_disjoint({"train": df([1, 2]), "val": df([3]), "test": df([2, 4])}, "id")
    windows.check_disjoint({"train": df([1]), "val": df([3])}, "id")


def test_splits_and_samples(spark):
    people = spark.range(200).select(F.col("id").alias("e"), (F.col("id") % 4 == 0).cast("int").alias("act"))
    s = windows.reserved_split(people, "e", "act", 42, 10, 10, 0.05).groupBy("act", "split").count().collect()
    assert {(r["act"], r["split"]): r["count"] for r in s} == {(1, "val"): 10, (1, "test"): 10, (1, "train"): 30, (0, "val"): 7, (0, "test"): 7, (0, "train"): 136}
    shares = windows.share_split(people, "e", 42, {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in shares} == {"train": 140, "val": 30, "test": 30}
    assert windows.downsample(people, "act", 2, 1, "e").where("act = 0").count() == 100
    assert windows.per_entity_limit(people.withColumn("g", F.col("e") % 5), "g", 3, 1, "e").count() == 15
    assert people.select(order_key(42, "e")).distinct().count() == 200
