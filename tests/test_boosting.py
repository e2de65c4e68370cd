"""Boosted and quantile forecasts, probes, ladders and retrieval: planted data, plain references, nulls, empty tables."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekspark.operators import boosting
from trekspark.operators.expressions import exact_quantiles
from trekspark.operators.boosting import benchmark_rows, fit_boosted, memory_prior, quantile_duration, residual_quantiles, retrieve_completion, scene_probe, source_estimator_grid, two_stage_duration

ROWS = "track long, x double, y double, z double, dur_s double, _x int, pred0 int"


def planted(seed, n, noise=10.0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, z = r.random(), r.random(), r.random()
        out.append((k // 5, x, y, z, 300.0 + 400.0 * (x > 0.5) + 100.0 * y + r.uniform(-noise, noise), 1, 2))
    return out


def test_boosted_trees_beat_the_median_and_stop_early(spark):
    train = spark.createDataFrame([*planted(1, 600), (999, None, 0.1, 0.1, 5.0, 1, 2), (998, 0.5, 0.1, 0.1, None, 1, 2)], ROWS)
    test = spark.createDataFrame([*planted(2, 200), (997, None, 0.5, 0.5, 1.0, 1, 2)], ROWS)
    model = fit_boosted(train, ["x", "y", "z"], trees=60, depth=3, rate=0.3)
    got = model.predict(test).collect()
    assert len(got) == 201 and sum(g.pred is None for g in got) == 1
    some = [g for g in got if g.pred is not None]
    median = np.median([r[4] for r in planted(1, 600)])
    assert sum(abs(g.pred - g.dur_s) for g in some) < 0.25 * sum(abs(median - g.dur_s) for g in some)
    assert model.model.getNumTrees < 60
    gain = {r.feature: r.gain for r in boosting.feature_importance(spark, model).collect()}
    assert sum(gain.values()) == pytest.approx(1) and max(gain, key=gain.get) == "x" and gain["z"] < 0.1
    with pytest.raises(ValueError, match="no train row"):
        fit_boosted(train.where("x > 5"), ["x", "y", "z"])


def test_quantiles_cover_planted_noise(spark):
    r = random.Random(3)
    rows = [(k, x, x + r.gauss(0, 1 + x / 50)) for k in range(20000) for x in [r.uniform(100, 200)]]
    df = spark.createDataFrame(rows, "id long, pred double, dur_s double")
    table = residual_quantiles(df.where("id % 2 = 0"), bins=5)
    test = df.where("id % 2 = 1").unionByName(spark.createDataFrame([(30001, 50.0, 50.0), (30003, None, 1.0)], df.schema))
    got = {x.id: x for x in quantile_duration(test, table).collect()}
    assert got[30003].q is None and len(got[30001].q) == 7 and len(got) == 10002
    inner = [x for x in got.values() if x.id < 20000]
    for k, level in enumerate(boosting.LEVELS):
        assert abs(np.mean([x.dur_s <= x.q[k].p for x in inner]) - level) < 0.02
    assert table.agg(F.sum("n")).first()[0] == 10000


def test_probe_tells_planted_scenes_apart(spark):
    r = random.Random(4)
    rows = [(k, s, 10.0 * s + r.random(), r.random() - 5 * s) for k in range(300) for s in [k % 3]] + [(300, None, 1.0, 1.0), (301, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, scene int, a double, b double")
    got = scene_probe(df.where("id < 200 OR id > 299"), df.where("id >= 200"), ["a", "b"], trees=30, depth=3).first()
    assert (got.n, got.classes, got.accuracy) == (100, 3, 1.0)


def test_true_next_regions_give_better_times_than_none(spark):
    r = random.Random(5)
    rows = []
    for track in range(120):
        at = r.randrange(3)
        for pos in range(1, 6):
            nxt = r.randrange(3)
            rows.append((track, pos, at, nxt if pos < 5 else None, 100.0 * pos, 10.0 + 300.0 * nxt if pos < 5 else None))
            at = nxt
    s = spark.createDataFrame(rows, "track_id long, pos int, region_id int, nxt int, t_s double, dur double")
    train, test = s.where("track_id < 80"), s.where("track_id >= 80")
    given = {"true": test.select("track_id", "pos", F.col("nxt").alias("pred")), "none": test.where("pos > 9").select("track_id", "pos", F.col("nxt").alias("pred"))}
    got = {x.predictor: x for x in two_stage_duration(train, test, given, trees=20, depth=3, rate=0.3).collect()}
    assert got["true"].mae < 20 < 60 < got["none"].mae and got["true"].next_hit == 1.0 and got["true"].n == 160


def test_ladder_matches_ridge_on_rows(spark):
    r = random.Random(6)
    rows = []
    for k in range(900):
        a, b = r.random(), r.gauss(0, 1)
        rows.append((k % 3, k // 3, a, b, 50.0 + 100 * a + 20 * b + 30 * (k % 3) + r.gauss(0, 1), 60.0))
    rows += [(0, 9999, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scene int, track long, a double, b double, dur_s double, naismith_s double")
    got = {(x.target, x.setting, x.grp): x for x in benchmark_rows(df, {"full": ["a", "b"], "one": ["b"]}, seeds=(7,)).collect()}
    marked = df.where("a IS NOT NULL").withColumn("train", F.pmod(F.xxhash64(F.col("track").cast("string"), F.lit(7)), F.lit(10)) < 7).collect()
    for target, (grp, columns), setting in itertools.product(range(3), (("full", "ab"), ("one", "b")), ("zero-shot", "self-train")):
        fit = [x for x in marked if x.train and (x.scene == target) == (setting == "self-train")]
        test = [x for x in marked if not x.train and x.scene == target]
        m = np.array([[x[c] for c in columns] for x in fit])
        mean, sd = m.mean(0), m.std(0) + 1e-6
        z, y = (m - mean) / sd, np.array([x.dur_s for x in fit])
        w = np.linalg.solve(z.T @ z + np.eye(len(columns)), z.T @ (y - y.mean()))
        said = np.maximum((np.array([[x[c] for c in columns] for x in test]) - mean) / sd @ w + y.mean(), 0)
        one = got[target, setting, grp]
        assert one.mae_min == pytest.approx(np.abs(said - [x.dur_s for x in test]).mean() / 60) and one.n_seg == len(test) and one.n_track == len({x.track for x in test})
    physics = [x for x in marked if not x.train and x.scene == 1]
    assert got[1, "physics", "full"].mae_min == pytest.approx(np.mean([abs(60 - x.dur_s) for x in physics]) / 60)


def plain_completion(seq, train, prefix, least, most):
    m, found = prefix, []
    while m >= 1 and len(found) < least:
        found = [(s, d) for s, d in train if len(s) > m and s[:m] == seq[:m]]
        m -= 1
    out = []
    for j in range(1, most + 1):
        at = prefix + j - 1
        nxt = Counter(s[at] for s, _ in found if len(s) > at)
        if not nxt:
            break
        region = min(nxt, key=lambda x: (-nxt[x], x))
        durs = [d[at] for s, d in found if len(s) > at and len(d) > at]
        out.append((j, region, round(float(np.mean(durs)), 6) if durs else 0.0, nxt[region]))
    return out


def test_retrieval_matches_plain_matching(spark):
    r = random.Random(8)
    make = lambda: [r.randrange(4) for _ in range(r.randint(1, 8))]
    tracks = {k: (s, [float(r.randint(1, 99)) for _ in s[1:]]) for k, s in ((k, make()) for k in range(120))}
    df = spark.createDataFrame([(k, s, d) for k, (s, d) in tracks.items()], "track_id long, seq array<int>, durs array<double>")
    got = {}
    for x in retrieve_completion(df.where("track_id >= 60"), df.where("track_id < 60"), 2, 3, 4).collect():
        got.setdefault(x.track_id, []).append((x.j, x.pred, round(x.dur, 6), x.votes))
    train = [tracks[k] for k in range(60)]
    want = {k: plain_completion(tracks[k][0], train, 2, 3, 4) for k in range(60, 120) if len(tracks[k][0]) >= 2}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_cumulative_errors_of_sources(spark):
    true = spark.createDataFrame([(1, 1, 0, 10.0), (1, 2, 0, 20.0), (2, 1, 0, 5.0)], "track_id long, j int, region_id int, dur double")
    given = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "track_id long, j int, by double")
    got = source_estimator_grid(true, {"a": given}, {"plus": lambda s, m: m.withColumn("est", F.col("dur") + F.col("by")), "none": lambda s, m: None}).collect()
    assert [tuple(x) for x in got] == [("a", "plus", 2, 2.0)]  # off by 1, then by 1 + 2


def test_memory_moves_the_label(spark):
    near = spark.createDataFrame([(1, 0.9, 7), (1, 0.8, 7), (1, 0.1, 3)], "q long, sim double, label int")
    scores = spark.createDataFrame([(1, 3, 1.0), (1, 7, 0.0), (1, 9, 0.5)], "q long, label int, score double")
    truth = spark.createDataFrame([(1, 7)], "q long, label int")
    got = {x["lambda"]: (x.hits, x.best) for x in memory_prior(near, scores, truth, (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: (0, False), 0.5: (1, True), 1.0: (1, False)}


def test_quantiles_are_exact_beyond_the_sketch(spark):
    """Residuals of more rows than a sketch of 100,000 keeps, many of them equal."""
    df = spark.range(400_000).select((F.pmod(F.xxhash64("id"), F.lit(300_007)) / 7).alias("pred"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("_r"))
    df = df.select("pred", (F.col("pred") + F.when(F.col("_r") < 300, 3.0).otherwise(F.col("_r"))).alias("dur_s"))
    rows = df.toPandas()
    at = lambda v, q: np.sort(v)[max(1, len(v) - math.floor(len(v) - len(v) * q)) - 1]
    edges = np.array([at(rows.pred.to_numpy(), k / 4) for k in range(1, 4)])
    bins = (edges[None] < rows.pred.to_numpy()[:, None]).sum(1)
    got = {x.bin: x for x in residual_quantiles(df, bins=4).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for b, x in got.items():
        own = (rows.dur_s - rows.pred).to_numpy()[bins == b]
        assert x.low == (None if b == 0 else edges[b - 1]) and x.n == len(own)
        assert x.q == [at(own, q) for q in boosting.LEVELS]


def test_exact_quantiles_of_keys_and_small_tables(spark):
    r = random.Random(8)
    rows = [(k % 3, None if k % 50 == 0 else r.choice([1.0, 2.5, r.gauss(0, 9)])) for k in range(4000)] + [(9, 4.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    levels = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (60, 20_000):
        got = {x.g: x.q for x in exact_quantiles(df, ["g"], "v", levels, True, accuracy).collect()}
        assert sorted(got) == [0, 1, 2, 9]
        for g, q in got.items():
            assert q == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], levels).tolist())
    assert [x.q for x in exact_quantiles(df.where("g = 8"), [], "v", levels, True).collect()] == [None]
