import random

import pytest

from tidegrid.operators import metrics, models


@pytest.mark.parametrize("kind,options", [("logistic", {}), ("elastic_net", {}), ("forest", {"numTrees": 10}), ("boosted", {"maxIter": 5})])
def test_baselines_rank_a_clear_signal(spark, kind, options):
    rng = random.Random(0)
    rows = [(i, x := rng.gauss(0, 1), rng.gauss(0, 1) if i % 7 else None, int(x + rng.gauss(0, 0.3) > 0.8)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    train, test = df.where("id < 160"), df.where("id >= 160")
    model = models.fit(train, ["a", "b"], "y", kind, **options)
    scored = models.score(model, test, train, ["a", "b"])
    assert scored.columns == ["id", "a", "b", "y", "score"]
    assert metrics.auroc(scored, "score", "y").first()[0] > 0.9
    assert models.importances(model, ["a", "b"])[0][0] == "a"
