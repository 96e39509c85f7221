from datetime import date

from pyspark.sql import functions as F

from tidegrid.operators import classify, clean


def one(spark, column, value, kind):
    df = spark.createDataFrame([(value, kind)], "value double, type string")
    return df.select(column.alias("x")).first()["x"]


def test_clipping_edges(spark):
    c = clean.clipped(F.col("value"), F.col("type"))
    cases = [("Temperature", 45.0, 45.0), ("Temperature", 45.1, None), ("Temperature", 29.9, 30.0), ("Heartrate", 29.0, 30.0), ("Heartrate", 220.0, 220.0), ("Heartrate", 221.0, 220.0)]
    cases += [("Saturation", 49.0, 50.0), ("Saturation", 101.0, 101.0), ("Steps", -1.0, 0.0), ("Steps", 50001.0, 50000.0), ("Steps", None, None), ("Else", 999.0, 999.0)]
    for kind, value, want in cases:
        assert one(spark, c, value, kind) == want, (kind, value)


def test_rounding_is_half_away(spark):
    r = clean.rounded(F.col("value"), F.col("type"))
    assert one(spark, r, 2.5, "Heartrate") == 3.0
    assert one(spark, r, -2.5, "Heartrate") == -3.0
    assert one(spark, r, 36.65, "Temperature") == 36.7


def test_pressure_pairs(spark):
    rows = [(1, 120.0, 120.0), (2, 100.0, 130.0), (3, 100.0, 91.0), (4, 100.0, 90.0), (5, None, 80.0), (6, 300.0, 30.0), (7, 60.0, 69.0)]
    df = spark.createDataFrame([(i, "BloodPressure", None, s, d) for i, s, d in rows], "id int, type string, value double, sbp double, dbp double")
    got = {r["id"]: (r["sbp"], r["dbp"], r["pulse_pressure"]) for r in clean.clean_readings(df).collect()}
    assert got[1] == got[2] == (None, None, None)
    assert got[3] == (100.0, 91.0, None) and got[4] == (100.0, 90.0, 10.0)
    assert got[5] == (None, 80.0, None) and got[6] == (250.0, 40.0, 210.0) and got[7] == (70.0, 69.0, None)


def test_people(spark):
    rows = [(1, "Unknown", 59, None), (2, "K", 60, None), (3, "M", 110, date(1916, 1, 1)), (4, "F", 111, None), (5, "M", 70, date(1957, 5, 5)), (6, "M", 70, date(1958, 5, 5)), (7, "Unknown", None, date(1950, 1, 1))]
    got = {r["id"]: (r["gender"], r["age"], r["birthdate"]) for r in clean.reconcile_people(spark.createDataFrame(rows, "id int, gender string, age int, birthdate date"), 2026).collect()}
    assert set(got) == {2, 3, 5, 6}
    assert got[2][2] == date(1966, 1, 1) and got[5][1] == 70 and got[6][1] == 68


def test_gender_codes(spark):
    df = spark.createDataFrame([(g,) for g in ("K", "Kobieta", "F", "female", "M", None, "Unknown")], "g string")
    assert [r[0] for r in df.select(clean.gender_code(F.col("g"))).collect()] == [1, 1, 1, 1, 0, None, None]


def test_severity_order(spark):
    notes = [(None, -1), ("", -1), ("ALARM PRZYPADKOWY, wezwanie zrm", 0), ("Nie nawiązano kontaktu", 2), ("nie nawiązano kontaktu; nawiązano kontakt", 2), ("Wezwanie ZRM", 3)]
    notes += [("brak wskazań do interwencji zrm, wezwanie zrm", -1), ("opiekun powiadomiony", 1), ("na podstawie odczytów z systemu wysłano zrm", 3)]
    df = spark.createDataFrame(notes, "note string, want int")
    assert df.where(~classify.severity(F.col("note")).eqNullSafe(F.col("want"))).count() == 0


def test_category_first_match_and_flags(spark):
    df = spark.createDataFrame([(1, "Chodzenie"), (1, "UDAR"), (2, "nic"), (3, None)], "id int, name string").withColumn("c", classify.category(F.col("name")))
    assert {(r["id"], r["c"]) for r in df.collect()} == {(1, "musculoskeletal"), (1, "neurological"), (2, "unclassified"), (3, "unclassified")}
    flags = {r["id"]: r.asDict() for r in classify.flags(df, "id", "c", [*classify.CATEGORIES, classify.OTHER]).collect()}
    assert flags[1]["neurological"] == 1 and flags[1]["sensory"] == 0 and flags[3]["unclassified"] == 1


def test_keys_fold_ascii_only(spark):
    df = spark.createDataFrame([(1, "Udar"), (2, "UDAR"), (3, "Łuszczyca"), (4, "łuszczyca"), (5, None)], "o int, name string")
    got = [(r["id"], r["name"]) for r in clean.surrogate_keys(df, "name", "o").orderBy("id").collect()]
    assert got == [(1, "Udar"), (2, "Łuszczyca"), (3, "łuszczyca")]


def test_split_upsert_insert_and_fill(spark):
    s = clean.split_names(spark.createDataFrame([(1, " a ,,b"), (2, None)], "id int, names string"), "names", "name")
    assert [(r["id"], r["name"]) for r in s.collect()] == [(1, "a"), (1, "b")]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, clean.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, clean.insert_missing(old, new, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    g = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 1.0, None, None, None, None, None, 2.0])], "e int, t int, v double")
    assert [r["v"] for r in clean.forward_fill(g, "e", "t", ["v"], 4).orderBy("t").collect()] == [None, 1.0, 1.0, 1.0, 1.0, 1.0, None, 2.0]
    assert [r["v"] for r in clean.fill_both_ways(g, "e", "t", ["v"]).orderBy("t").collect()] == [1.0] * 7 + [2.0]
    assert clean.keep_last(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string"), ["k"], ["o"]).first()["v"] == "b"
