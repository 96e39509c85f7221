import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import cohort, flatten, metrics, relational


def scored(spark, rows):
    return spark.createDataFrame(rows, "s double, y int")


@pytest.mark.parametrize("rows,want", [([(0.9, 1), (0.1, 0)], 1.0), ([(0.1, 1), (0.9, 0)], 0.0), ([(0.5, 1), (0.5, 0)], 0.5), ([(0.5, 1), (0.4, 1)], None)])
def test_auroc_goldens(spark, rows, want):
    assert metrics.auroc(scored(spark, rows), "s", "y").first()[0] == want


def test_auroc_and_average_precision_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(80)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auroc(scored(spark, rows), "s", "y").first()[0] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, k = sum(s >= t and y for s, y in rows), sum(s >= t for s, _ in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / k, tp / len(pos)
    assert metrics.average_precision(scored(spark, rows), "s", "y").first()[0] == pytest.approx(ap)
    low, high, n = metrics.bootstrap_auroc(scored(spark, rows).withColumn("i", F.monotonically_increasing_id()), "s", "y", "i", 200).first()
    assert low < auc < high and n == 200


def test_thresholds(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0)])
    assert metrics.youden_point(df, "s", "y").first()["threshold"] == 0.9
    assert metrics.best_f1(df, "s", "y").first()["f1"] == pytest.approx(0.8)
    assert metrics.precision_at_recall(df, "s", "y").first()[0] == pytest.approx(2 / 3)
    assert tuple(metrics.confusion(df, "s", "y", 0.7).select("tn", "fp", "fn", "tp").first()) == (1, 1, 0, 2)
    assert metrics.chi_square_2x2(spark.createDataFrame([(1, 1)] * 10 + [(0, 0)] * 10, "a int, b int"), "a", "b").first()["chi2"] == pytest.approx(16.2)
    one = spark.range(1).select(metrics.priority_decision({1: (F.lit(0.9), 0.5), 3: (F.lit(0.2), 0.5), 2: (F.lit(0.5), 0.5)}))
    assert one.first()[0] == 2


def test_flatten_ignores_missing_and_uses_population_deviation(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 5.0, None), (1, 1, None, 6.0, None), (1, 2, 3.0, 7.0, None), (2, 0, 4.0, None, None)], "k int, t int, a double, st double, z double")
    got = {r["k"]: r for r in flatten.flatten(df, ["k"], "t", ["a", "z"], ["st"]).collect()}
    assert list(got[1].asDict()) == ["k", "a_mean", "z_mean", "a_std", "z_std", "a_max", "z_max", "a_min", "z_min", "st"]
    assert (got[1]["a_mean"], got[1]["a_std"], got[1]["z_mean"], got[1]["st"]) == (2.0, 1.0, None, 5.0)
    assert got[2]["a_std"] == 0.0 and got[2]["st"] is None


def test_normalise_impute_active_dummies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "id int, x double")
    assert [r["x"] for r in flatten.normalise(df, df, ["x"]).orderBy("id").collect()] == [-1.0, 1.0, 0.0]
    assert [r["x"] for r in flatten.median_impute(df, df, ["x"]).orderBy("id").collect()] == [1.0, 3.0, 2.0]
    assert flatten.active(spark.createDataFrame([(0.0,), (1e-7,), (2.0,), (None,)], "x double"), ["x"]).count() == 1
    d = flatten.dummies(spark.createDataFrame([("a",), ("b",), (None,)], "c string"), "c", ["a", "b"])
    assert [r["c_b"] for r in d.collect()] == [0, 1, 0]
    e = flatten.reconstruction_error(spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "p array<double>, q array<double>"), "p", "q")
    assert e.first()["error"] == 2.0
    assert flatten.without_patterns(["hour_sin_mean", "x"], ["hour"]) == ["x"]


def test_cohort_and_relational(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert {r["id"]: r["origin"] for r in cohort.gold(a, b, "id").collect()} == {1: "first only", 2: "both", 3: "second only"}
    assert {r["op"]: r["n"] for r in relational.set_table(a, b, "id").collect()} == {"union": 3, "intersect": 1, "a_minus_b": 1, "b_minus_a": 1}
