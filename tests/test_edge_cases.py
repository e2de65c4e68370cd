"""Hand-computed cases."""

import math
import pytest
from pyspark.sql import functions as F

from trekspark.functions.geo import haversine_m
from trekspark.operators.expressions import time_to_seconds
from trekspark.operators.filters import drop_jump_tracks, filter_polygon
from trekspark.operators.forecast import prior_lookup
from trekspark.operators.statistics import markov_rollout
from trekspark.operators.trajectory import compress_sequence, detect_stays, distance_segments, interpolate_nulls, propagate_labels


def test_time_to_seconds(spark):
    rows = [("2014-03-15 05:26.16", 19576.0), ("00:07.5", 425.0), ("12:30", 750.0), ("x", None), ("5.5", 5.5), (None, None)]
    got = spark.createDataFrame(rows, "s string, want double").select("want", time_to_seconds("s").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_haversine(spark):
    one = spark.range(1).select(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert one.d == pytest.approx(111194.927, abs=1e-3) and one.n is None


def test_polygon_is_half_open(spark):
    ring = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (0, 3, 0.0, 1.0)], "scene int, i int, lon double, lat double")
    points = spark.createDataFrame([("centre", 0, 0.5, 0.5), ("far", 0, 5.0, 5.0), ("top", 0, 0.5, 1.0), ("bottom", 0, 0.5, 0.0)], "k string, scene int, lon double, lat double")
    assert {r.k for r in filter_polygon(points, ring).collect()} == {"centre", "top"}


def _points(spark, rows):
    return spark.createDataFrame(rows, "track_id long, event_id long, t_s double, lon double, lat double, speed_kmh double")


def test_jumps_without_time_do_not_count(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 1, 0.0, 1.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0, 0.0)]
    assert {r.track_id for r in drop_jump_tracks(_points(spark, rows)).collect()} == {1, 3}


def test_stays(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0), (1, 1, 29.0, 0.0, 0.0, 0.5), (1, 2, 30.0, 0.0, 0.0, 5.0), (1, 3, 40.0, 0.0, 0.0, 0.0), (1, 4, 70.0, 0.0, 0.0, 1.0), (2, 0, 0.0, 0.0, 0.0, None)]
    got = {(r.track_id, r.event_id) for r in detect_stays(_points(spark, rows)).where("stay").collect()}
    assert got == {(1, 3), (1, 4)}


def test_greedy_segments_restart_at_the_cut(spark):
    step = 60 / 111194.927
    rows = [(1, i, float(i), 0.0, i * step, 0.0) for i in range(7)]
    got = [r.seg for r in distance_segments(_points(spark, rows), 100.0).orderBy("event_id").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3]


def test_sequences_and_fills(spark):
    rows = [(1, i, float(i), r, v) for i, (r, v) in enumerate([(-1, None), (-1, 1.0), (5, None), (-1, 3.0), (7, None), (-1, None)])]
    df = spark.createDataFrame(rows, "track_id long, event_id long, t_s double, region_id int, v double")
    assert [r.region_id for r in propagate_labels(df, "region_id").orderBy("event_id").collect()] == [5, 5, 5, 5, 7, 7]
    assert [r.v for r in interpolate_nulls(df, "v").orderBy("event_id").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert [r.region_id for r in compress_sequence(df).orderBy("event_id").collect()] == [-1, 5, -1, 7, -1]


def test_prior_of_a_new_pair_is_the_mean_over_all_steps(spark):
    prior = spark.createDataFrame([(1, 2, 10.0, 3), (2, 3, 50.0, 1)], "region_id int, nxt int, mu double, n long")
    test = spark.createDataFrame([(7, 1, 2), (8, 3, 1)], "track_id long, region_id int, nxt int")
    assert {r.track_id: r.mu for r in prior_lookup(test, prior).collect()} == {7: 10.0, 8: 20.0}


def test_rollout_goes_on_to_the_end_of_each_track(spark):
    after = {1: 2, 2: 3, 3: 4, 4: 2}
    train = spark.createDataFrame([(a, b) for a, b in after.items()] + [(5, 9), (6, 9), (7, 9)], "region_id int, nxt int")
    rows = [(t, pos, start if pos == 2 else 0) for t, start, n in ((1, 1, 13), (2, 4, 3), (3, 9, 5), (4, 8, 4), (5, 1, 2)) for pos in range(1, n + 1)]
    got = {(r.track_id, r.pos): r.pred for r in markov_rollout(spark.createDataFrame(rows, "track_id long, pos int, region_id int"), train).collect()}
    want = {}
    for t, start, n in ((1, 1, 13), (2, 4, 3), (3, 9, 5), (4, 8, 4)):
        for pos in range(3, n + 1):
            start = after.get(start, 9)
            want[t, pos] = start
    assert got == want


def test_ridge_with_nulls_and_without_train_rows(spark):
    from trekspark.operators.learned import ridge_duration

    rows = [(k, float(k % 7), 3.0 * (k % 7) + 5) for k in range(50)]
    train = spark.createDataFrame([*rows, (90, None, 1.0), (91, 2.0, None)], "id long, x double, dur_s double")
    test = spark.createDataFrame([(1, 2.0), (2, None)], "id long, x double")
    got = {r.id: r.pred for r in ridge_duration(train, test, ["x"]).collect()}
    assert abs(got[1] - 11.0) < 0.5 and got[2] is None
    assert {r.pred for r in ridge_duration(train.where("id > 1000"), test, ["x"]).collect()} == {None}


def test_csv_with_a_repeated_name_in_its_header(spark, tmp_path):
    from trekspark.sources.files import read_track_csv

    (tmp_path / "a.csv").write_text("lon,lat,note,note\n1.5,2.5,first,second\n")
    (tmp_path / "b.csv").write_text("lat,lon\n3.5,4.5\n")
    got = sorted(tuple(r) for r in read_track_csv(spark, str(tmp_path), ("lon", "lat")).select("lon", "lat", "note").collect())
    assert got == [(1.5, 2.5, "first"), (4.5, 3.5, None)]


def test_pois_far_from_the_path_snap_too(spark):
    import random

    from trekspark.functions.geo import EARTH_M
    from trekspark.operators.spatial import project_to_path

    r = random.Random(1)
    path = [(s, t, e, 103 + r.gauss(0, 0.002), 30 + r.gauss(0, 0.002), 1.0) for s in (0, 1) for t in range(3) for e in range(40)] + [(2, 9, 0, 103.0, 30.0, 1.0), (0, 9, 1, None, 30.0, 1.0)]
    poi = [(s, 100 * s + k, "05", 103 + r.gauss(0, w), 30 + r.gauss(0, w)) for s in (0, 1, 2) for k, w in enumerate([0.001] * 30 + [0.3] * 5)] + [(0, 999, "05", None, 30.0), (7, 998, "05", 103.0, 30.0)]
    got = {x.poi_id: (x.track_id, x.event_id) for x in project_to_path(spark.createDataFrame(poi, "scene int, poi_id long, type_code string, lon double, lat double"), spark.createDataFrame(path, "scene int, track_id long, event_id long, lon double, lat double, ele double"), 33e-5).collect()}

    def metres(a, b):
        import math

        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return round(2 * EARTH_M * math.asin(math.sqrt(x)), 3)

    want = {}
    for s, i, _, x, y in poi:
        near = sorted((((p[3] - x) ** 2 + (p[4] - y) ** 2) ** 0.5, p[1], p[2], p[3], p[4]) for p in path if p[0] == s and p[3] is not None and x is not None)[:5]
        if near:
            want[i] = min((metres((x, y), n[3:]), k, n[1:3]) for k, n in enumerate(near))[2]
    assert got == want and len(got) == 105


def test_correlation_of_a_constant_is_nan(spark):
    """Copies of one track have the same residual at a position, where corr raised a division by zero."""
    from trekspark.operators.statistics import correlation

    rows = [(0, 1.0, 2.0), (0, 1.0, 5.0), (1, 1.0, 2.0), (1, 2.0, 4.5), (1, 3.0, 5.0), (1, None, 9.0)]
    got = {x.g: x.r for x in spark.createDataFrame(rows, "g int, x double, y double").groupBy("g").agg(correlation("x", "y").alias("r")).collect()}
    assert math.isnan(got[0]) and abs(got[1] - 0.9332565252573828) < 1e-9
