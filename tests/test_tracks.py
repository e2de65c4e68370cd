"""Tiles, simplified lines and step edges: round trips, plain references, odd inputs."""

import itertools
import random

import numpy as np
import pytest

from trekspark.operators.tracks import relation_edges, significance, simplify_lines
from trekspark.sources.tiles import decode, read_dem, write_dem


def test_tiles_come_back(spark, tmp_path):
    r = random.Random(1)
    rows = [(name, i, j, r.choice([None, float(r.randint(-400, 8800))])) for name in ("N29E103", "N30E103", "x.y") for i in range(40) for j in range(40) if r.random() > 0.05]
    rows += [("N29E103", 40, 0, 5.0), ("N29E103", -1, 0, 5.0), (None, 1, 1, 5.0)]  # outside, and of no tile
    df = spark.createDataFrame(rows, "tile string, row_i int, col_i int, z double").repartition(5)
    path = f"file://{tmp_path}/tiles"
    write_dem(df, path, 40)
    assert sorted(p.name for p in (tmp_path / "tiles").iterdir()) == ["N29E103.hgt", "N30E103.hgt", "x.y.hgt"]
    assert all(p.stat().st_size == 2 * 40 * 40 for p in (tmp_path / "tiles").iterdir())
    want = {(t, i, j): int(z) if z is not None else None for t, i, j, z in rows if t and 0 <= i < 40}
    got = {(x.tile, x.row_i, x.col_i): x.z for x in read_dem(spark, path).collect()}
    assert len(got) == 3 * 1600 and all(got[k] == want.get(k) for k in got)


def test_bytes_of_a_tile():
    batch = next(decode("t", b"\x00\x01\x80\x00\xff\xff\x7f\xff"))
    assert batch.column(3).to_pylist() == [1, None, -1, 32767] and batch.column(1).to_pylist() == [0, 0, 1, 1]
    with pytest.raises(ValueError, match="no square"):
        next(decode("t", b"123456"))


def plain_peucker(x, tolerance):
    if len(x) <= 2:
        return list(range(len(x)))
    a, b = x[0], x[-1]
    way = b - a
    d = [np.linalg.norm(p - a) if not way.any() else abs(way[0] * (p - a)[1] - way[1] * (p - a)[0]) / np.linalg.norm(way) for p in x[1:-1]]
    k = int(np.argmax(d)) + 1
    if d[k - 1] <= tolerance:
        return [0, len(x) - 1]
    return plain_peucker(x[: k + 1], tolerance)[:-1] + [k + i for i in plain_peucker(x[k:], tolerance)]


def test_significance_is_what_each_tolerance_keeps():
    r = np.random.default_rng(2)
    for n in (2, 3, 9, 120):
        x = r.normal(0, 1, (n, 2)).cumsum(0)
        for closed in (False, True):
            if closed:
                x[-1] = x[0]
            for tolerance in (0.0, 0.3, 1.0, 4.0):
                assert np.flatnonzero(significance(x) > tolerance).tolist() == plain_peucker(x, tolerance)


def test_lines_keep_few_vertices_and_stay_near(spark):
    r = np.random.default_rng(3)
    lines = {k: r.normal(0, 1e-4, (n, 2)).cumsum(0) for k, n in ((1, 400), (2, 30), (3, 1), (4, 77))}
    lines[5] = np.zeros((50, 2))  # one place
    rows = [(k, i, float(p[0]), float(p[1]), "a") for k, x in lines.items() for i, p in enumerate(x)] + [(4, 500, None, 1.0, "a")]
    df = spark.createDataFrame(rows, "track_id long, t_s long, lon double, lat double, vertex0 string").repartition(4)
    got = {}
    for x in simplify_lines(df, ["track_id"], ["t_s"]).collect():
        got.setdefault(x.track_id, []).append(x)
    for k, x in lines.items():
        kept = sorted(got[k], key=lambda v: v.vertex)
        assert [v.vertex for v in kept] == list(range(len(kept))) and len(kept) <= 30
        at, tolerance = [v.t_s for v in kept], kept[0].tolerance
        assert at == sorted(at) and (at[0], at[-1]) == (0, len(x) - 1)
        assert at == (list(range(len(x))) if len(x) <= 30 else plain_peucker(x, tolerance))
        for a, b in itertools.pairwise(at):  # nothing lies farther from the line than the tolerance
            way, inner = x[b] - x[a], x[a : b + 1] - x[a]
            d = np.abs(way[0] * inner[:, 1] - way[1] * inner[:, 0]) / np.hypot(*way) if way.any() else np.hypot(*inner.T)
            assert d.max() <= tolerance + 1e-12
    assert len(got[1]) == 30 and len(got[5]) == 2


def test_edges_match_a_plain_search(spark):
    r = random.Random(4)
    rows = []
    for track in range(30):
        for pos in range(1, r.randint(2, 20)):
            v = r.choice([None, [0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.2, 0.9]])
            rows.append((track, pos, r.choice([0, 1, 2, None]), r.choice([0, 1, None]), v, "x"))
    got = {tuple(x) for x in relation_edges(spark.createDataFrame(rows, "track_id long, pos int, role int, bin int, v array<double>, kind string"), 5).collect()}
    want = set()
    for track in range(30):
        mine = [x for x in rows if x[0] == track]
        for b in mine:
            past = [a for a in mine if 0 < b[1] - a[1] <= 5]
            sims = []
            for a in past:
                if a[1] == b[1] - 1:
                    want.add((track, "next", a[1], b[1]))
                for kind, c in (("role", 2), ("bin", 3)):
                    if a[c] is not None and a[c] == b[c]:
                        want.add((track, kind, a[1], b[1]))
                if a[4] is not None and b[4] is not None:
                    size = np.linalg.norm(a[4]) * np.linalg.norm(b[4])
                    sims.append((-round(float(np.dot(a[4], b[4]) / size) if size else 0.0, 9), a[1]))
            want |= {(track, "poi", j, b[1]) for _, j in sorted(sims)[:2]}
    assert got == want


def test_steps_are_sorted_once_and_not_joined_with_each_other(spark):
    rows = spark.createDataFrame([(1, p, p % 2, 0, [1.0, float(p)]) for p in range(1, 30)], "track_id long, pos int, role int, bin int, v array<double>")
    for causal in (True, False):
        edges = relation_edges(rows, causal=causal)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        assert edges.where("kind = 'poi'").groupBy("k").count().where("count > 2").count() == 0


def test_edges_reach_all_of_a_track(spark):
    """Steps far apart meet too: every pair of one role, and the most similar of all steps before."""
    n = 300
    rows = [(1, p, p % 7, None, [1.0, float(p % 50)] if p % 3 else None) for p in range(1, n + 1)] + [(None, 1, 0, 0, [1.0, 1.0]), (None, 2, 0, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "track_id long, pos int, role int, bin int, v array<double>")
    for causal in (True, False):
        got = [tuple(x) for x in relation_edges(df, causal=causal).collect()]
        want = {(1, "next", p, p + 1) for p in range(1, n)} | {(1, "role", a, b) for a in range(1, n + 1) for b in range(a + 7, n + 1, 7)}
        want |= set() if causal else {(t, kind, b, a) for t, kind, a, b in want}
        for b in range(1, n + 1):
            near = sorted((-round((1 + (a % 50) * (b % 50)) / np.hypot(1, a % 50) / np.hypot(1, b % 50), 9), a) for a in range(1, n + 1) if a != b and a % 3 and b % 3 and (a < b or not causal))
            want |= {(1, "poi", a, b) for _, a in near[:2]}
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_vectors_have_defined_edges(spark):
    v = [[1.0, 0.0], [1.0], [1.0, None], [float("nan"), 1.0], [0.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([("a", p, None, None, x) for p, x in enumerate(v)], "track_id string, pos long, role string, bin double, v array<double>")
    got = {(x.j, x.k) for x in relation_edges(df, k=1).collect() if x.kind == "poi"}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)} and relation_edges(df.limit(0)).collect() == []
