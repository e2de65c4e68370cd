"""Spark ML operators: better than the mean, planted clusters, nulls."""

import random

from pyspark.sql import functions as F

from trekspark.operators.models import forest_duration, kmeans
from trekspark.plans.catalog import QUERIES


def test_forest_beats_the_mean_and_leaves_nulls(spark):
    r = random.Random(1)
    rows = [(k, x, y, 100.0 * x + 10.0 * y) for k in range(400) for x, y in [(r.random(), r.random())]]
    train = spark.createDataFrame([*rows[:300], (900, None, 1.0, 5.0), (901, 1.0, 1.0, None)], "id long, x double, y double, dur_s double")
    test = spark.createDataFrame([*rows[300:], (902, None, 0.5, 1.0)], "id long, x double, y double, dur_s double")
    got = {g.id: g for g in forest_duration(train, test, ["x", "y"], trees=20).collect()}
    assert len(got) == 101 and got[902].pred is None
    mean = sum(x[3] for x in rows[:300]) / 300
    some = [g for g in got.values() if g.pred is not None]
    assert sum(abs(g.pred - g.dur_s) for g in some) < 0.3 * sum(abs(mean - g.dur_s) for g in some)


def test_kmeans_finds_planted_clusters(spark):
    r = random.Random(2)
    rows = [(k, 10.0 * (k % 3) + r.random(), 5.0 * (k % 3 == 1) + r.random()) for k in range(90)] + [(90, None, 1.0)]
    got = {x.id: x.cluster for x in kmeans(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"]).collect()}
    assert all(got[k] == k % 3 for k in range(90)) and got[90] is None


def test_queries_give_rows_for_all(spark):
    sf = "/root/testdata/sf0.001"
    roles = QUERIES["kmeans"](spark, sf).collect()
    assert len({(x.scene, x.region_id) for x in roles}) == len(roles) > 0 and {x.cluster for x in roles} == {0, 1, 2}
    scores = QUERIES["forest_duration"](spark, sf)
    assert scores.agg(F.min("mae") > 0).first()[0]


def test_forest_query_grows_all_trees(spark, monkeypatch):
    from trekspark.operators import models

    made, forest = [], models.RandomForestRegressor
    monkeypatch.setattr(models, "RandomForestRegressor", lambda **args: made.append(args) or forest(**{**args, "numTrees": 2}))
    QUERIES["forest_duration"](spark, "/root/testdata/sf0.001")
    assert [(x["numTrees"], x["maxDepth"]) for x in made] == [(200, 6)]


def test_kmeans_takes_the_best_start_and_k(spark):
    """Four planted groups in a row: single starts may stop at a worse split, the best of ten does not; k by silhouette is four."""
    r = random.Random(5)
    rows = [(g * 20 + i, x + r.random(), r.random()) for g, x in enumerate((0.0, 10.0, 40.0, 50.0)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    from trekspark.operators.models import best_groups

    for k in (4, (3, 4)):
        assert all(x.cluster == x.id // 20 for x in kmeans(df, ["a", "b"], k, scale=False).collect())
    import numpy as np

    x = np.array([row[1:] for row in rows])
    assert best_groups(x, 4).tolist() == [i // 20 for i in range(80)]
    assert best_groups(np.zeros((5, 2)), 3).tolist() == [best_groups(np.zeros((5, 2)), 3)[0]] * 5


def test_roles_are_a_scene_s_own_by_elevation_and_stay(spark):
    from trekspark.operators.models import region_places, region_roles, shared_prototypes

    rows = [(s, g, 103.0 + s, 29.0 + g / 100, 1000.0 * s + 100.0 * (g % 3) + p, 100.0 * g * p, p < 4 or s == 2) for s in (1, 2) for g in range(9) for p in range(6)]
    rows += [(3, 7, 1.0, 1.0, 5.0, 0.0, False), (3, 9, 1.0, 1.0, 900.0, 0.0, True), (4, 1, 2.0, 2.0, None, 0.0, True)]
    places = region_places(spark.createDataFrame(rows, "scene int, region_id int, lon double, lat double, ele double, t_s double, stop boolean").repartition(3))
    got = {(x.scene, x.region_id): x for x in shared_prototypes(region_roles(places)).collect()}
    assert len(got) == 21 and [got[1, g].stay_s for g in range(4)] == [0.0, 100.0, 200.0, 300.0] and got[3, 7].stay_s == 0.0
    assert {got[1, g].cluster for g in range(9)} == {got[2, g].cluster for g in range(9)} == {0, 1, 2}
    assert (got[3, 7].cluster, got[3, 9].cluster, got[4, 1].cluster, got[4, 1].prototype) == (0, 1, None, None)
    assert len({x.prototype for x in got.values() if x.prototype is not None}) <= 20
