"""Spectral operators against numpy, scores against plain formulas, planted blobs, lone balls, empty tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekspark.operators import regions
from trekspark.operators.balls import ball_table
from trekspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def blobs(seed, groups, size, spread=0.05):
    r = np.random.default_rng(seed)
    centres = [(3.0 * math.cos(2 * math.pi * g / groups), 3.0 * math.sin(2 * math.pi * g / groups)) for g in range(groups)]
    return [(g * size + k, g, float(x), float(y)) for g, c in enumerate(centres) for k, (x, y) in enumerate(r.normal(c, spread, (size, 2)))]


def edges_of(rows, gamma=1.0):
    return [(a[0], b[0], math.exp(-gamma * ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2))) for a, b in itertools.combinations(rows, 2)]


@pytest.mark.parametrize(("groups", "size"), [(3, 12), (4, 40)])  # below and above the size that the driver solves
def test_spectral_clusters_find_blobs_and_eigenvalues(spark, groups, size):
    rows = blobs(groups, groups, size)
    edges = spark.createDataFrame(edges_of(rows), "a long, b long, w double")
    nodes = spark.createDataFrame([(r[0],) for r in rows], "node long")
    got = {x.node: x.cluster for x in regions.spectral_clusters(edges, nodes, groups).collect()}
    assert len(set(got.values())) == groups and len({(got[r[0]], r[1]) for r in rows}) == groups  # purity 1
    w = np.eye(len(rows))
    for a, b, x in edges_of(rows):
        w[a, b] = w[b, a] = x
    _, values = regions.spectral_embedding(edges, nodes, groups)
    assert values == pytest.approx(np.linalg.eigvalsh(regions.laplacian(w))[:groups].tolist(), abs=1e-7)


def plain_k(values, low, high):
    n = len(values)
    high = min(high, n - 1)
    if n < 3 or low >= high:
        return 1
    gaps = [(values[i + 1] - values[i], -i) for i in range(max(0, low - 1), min(high, high - 1))]
    return min(max(low, 1 - max(gaps)[1]), high) if gaps else 1


def test_eigengap_in_spark_and_in_a_task_agree(spark):
    r = random.Random(1)
    tables = {g: sorted(r.random() for _ in range(r.choice([1, 2, 3, 4, 9, 30]))) for g in range(40)}
    df = spark.createDataFrame([(g, i, v) for g, x in tables.items() for i, v in enumerate(x)], "g int, i int, value double")
    for low, high in ((2, 5), (3, 40), (6, 6), (1, 2)):
        got = {x.g: x.k for x in regions.choose_k_eigengap(df, ["g"], low, high).collect()}
        assert got == {g: plain_k(x, low, high) for g, x in tables.items()} == {g: regions.eigengap_k(np.array(x), low, high) for g, x in tables.items()}


def plain_tree(w, nodes, low, high, least):
    """Sets of nodes: the same recursion over explicit subgraphs, with k-means by exhaustive restarts replaced by the blobs' own gaps."""
    if len(nodes) < max(least, 3):
        return [set(nodes)]
    sub = w[np.ix_(nodes, nodes)]
    d = sub.sum(1)
    values, vectors = np.linalg.eigh(np.eye(len(nodes)) - sub / np.sqrt(np.outer(d, d)))
    k = plain_k(values.tolist(), low, high)
    if k <= 1:
        return [set(nodes)]
    rows = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=1, keepdims=True)
    groups = []
    for i, x in enumerate(rows):  # rows of a blob agree up to a small angle
        for g in groups:
            if rows[g[0]] @ x > 0.5:
                g.append(i)
                break
        else:
            groups.append([i])
    assert len(groups) == k
    return [s for g in groups for s in plain_tree(w, [nodes[i] for i in g], 2, 3, least)]


def test_recursive_clusters_match_a_plain_tree(spark):
    rows, n = [], 0
    for g, (x, y) in enumerate([(0, 0), (0, 0.9), (9, 0), (9, 1.0), (0, 9), (9, 9)]):
        for at in np.random.default_rng(g).normal((x, y), 0.02, (10, 2)):
            rows.append((n, g, *map(float, at)))
            n += 1
    edges = spark.createDataFrame([(0, a, b, w) for a, b, w in edges_of(rows, 2.0)] + [(1, 5, 5, 1.0)], "scene int, a long, b long, w double")
    bounds = spark.createDataFrame([(s, 3, 5, 15) for s in (0, 1)], "scene int, k_low int, k_high int, least int")
    got = {}
    for x in regions.recursive_spectral(edges, ["scene"], bounds, (2, 3)).collect():
        got.setdefault((x.scene, x.cluster), set()).add(x.ball)
    w = np.eye(n)
    for a, b, x in edges_of(rows, 2.0):
        w[a, b] = w[b, a] = x
    want = plain_tree(w, list(range(n)), 3, 5, 15)
    assert sorted(map(sorted, (s for (scene, _), s in got.items() if scene == 0))) == sorted(map(sorted, want))
    assert got[1, 0] == {5} and len(want) == 6


def test_graphs_of_balls_need_no_table_of_pairs(spark):
    r = random.Random(9)
    rows = [(s, k, [r.random() * 4, r.random() * 4], r.choice([0.0, 0.1, 0.5, 1.0])) for s in (0, 1) for k in range(25)] + [(2, 7, [0.0, 0.0], 0.0)]
    balls = spark.createDataFrame(rows, "scene int, ball long, centre array<double>, radius double")
    keys = ["scene", "delta"]
    edges = regions.with_loops(regions.affinity_edges(balls, ["scene"], (0.2, 0.9)), balls, keys).where("scene < 2")
    want = {(x.scene, x.delta, x.i): x.value for x in regions.graph_eigenvalues(edges, keys).collect()}
    got = {(x.scene, x.delta, x.i): x.value for x in regions.ball_eigenvalues(balls, ["scene"], (0.2, 0.9)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 2} == pytest.approx(want, abs=1e-12) and len(got) == len(want) + 2
    rows = np.random.default_rng(2).normal(size=(50, 4))
    whole = regions.nearest_groups(rows, 6)
    held, regions.NUMBERS = regions.NUMBERS, 100
    try:
        assert (regions.nearest_groups(rows, 6) == whole).all()
    finally:
        regions.NUMBERS = held


def plain_composite(rows):
    labels = sorted({r[1] for r in rows})
    if len(labels) < 2:
        return 0.0
    x = {g: np.array([r[2:4] for r in rows if r[1] == g]) for g in labels}
    sq = lambda p, q: ((p - q) ** 2).sum(1)
    sil = []
    for r in rows:
        p = np.array(r[2:4])
        if len(x[r[1]]) == 1:
            sil.append(0.0)
            continue
        a = sq(x[r[1]], p).sum() / (len(x[r[1]]) - 1)
        b = min(sq(x[g], p).mean() for g in labels if g != r[1])
        sil.append((b - a) / max(a, b) if max(a, b) else 0.0)
    share = [len(x[g]) / len(rows) for g in labels]
    centre = {g: x[g].mean(0) for g in labels}
    gap = min(np.linalg.norm(centre[a] - centre[b]) for a, b in itertools.combinations(labels, 2))
    spread = [np.sqrt(sq(x[g], centre[g])).mean() for g in labels if len(x[g]) > 1]
    within = np.mean(spread) if spread else 1.0
    balance = -sum(p * math.log(p + 1e-12) for p in share) / math.log(len(labels))
    return 0.5 * (np.mean(sil) + 1) / 2 + 0.2 * balance + 0.3 * (min(1.0, gap / (within + 1e-12)) if within > 0 else 0.0)


def test_composite_score_matches_plain_formulas(spark):
    r = random.Random(5)
    tables = {
        0: blobs(1, 3, 9, 1.0),
        1: [(k, 0, r.random(), r.random()) for k in range(5)],
        2: [(0, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (2, 2, 5.0, 5.0)],
        3: [(k, k % 2, 1.0, 1.0) for k in range(6)],
        4: [(k, r.randrange(4), r.random(), r.random()) for k in range(40)],
    }
    df = spark.createDataFrame([(s, *x) for s, rows in tables.items() for x in rows] + [(0, 99, None, 1.0, 1.0)], "scene int, id long, label int, x double, y double")
    got = {x.scene: x.score for x in regions.composite_score(df, ["x", "y"], ["scene"], "label").collect()}
    assert got == pytest.approx({s: plain_composite(rows) for s, rows in tables.items()})


def test_best_delta_and_its_ties(spark):
    scores = spark.createDataFrame([(0, 0.2, 3, 0.5), (0, 0.1, 4, 0.5), (0, 0.9, 2, 0.4), (1, 0.3, 1, 0.9), (2, 0.7, 2, -0.2)], "scene int, delta double, k int, score double")
    got = {x.scene: (x.delta, x.k, x.score) for x in regions.grid_search_delta(scores, ["scene"]).collect()}
    assert got == {0: (0.1, 4, 0.5), 1: (0.5, 1, None), 2: (0.7, 2, -0.2)}


def test_regions_of_planted_places(spark):
    """Stays at far places get a region each, at least; a model of train tracks does not move with test rows."""
    r = random.Random(6)
    places = [(103.0 + 0.01 * i, 30.0 + 0.01 * j) for i in range(4) for j in range(3)]
    rows = []
    for k in range(3600):
        lon, lat = places[k % 12]
        rows.append((k % 30, k, k % 2, lon + r.gauss(0, 1e-4), lat + r.gauss(0, 1e-4), 1000.0 + (k % 12) * 10, k % 5 != 4))
    rows.append((31, 9999, 0, None, 30.0, 1.0, True))
    df = spark.createDataFrame(rows, "track_id long, event_id long, scene int, lon double, lat double, ele double, stop boolean")
    model, centroids = regions.fit_regions(df, deltas=(0.3, 0.7))
    got = {x.event_id: (x.scene, x.region_id) for x in regions.discover_regions(df, model, centroids).collect()}
    assert len(got) == len(rows) and got[9999] == (0, None)
    held = {}
    for k in range(3600):
        held.setdefault(got[k], set()).add(k % 12)
    assert all(len(x) == 1 for x in held.values())  # no region mixes two places
    for scene in (0, 1):
        ids = {i for s, i in held if s == scene}
        assert ids == set(range(len(ids))) and len(ids) >= 6
    again, more = regions.fit_regions(df.where("track_id < 31"), deltas=(0.3, 0.7))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, centroids.collect()))


def test_containing_ball_prefers_the_smallest(spark):
    balls = spark.createDataFrame([(0, 1, [0.0, 0.0], 5.0), (0, 2, [1.0, 0.0], 2.0), (0, 3, [50.0, 0.0], 0.0)], "scene int, ball long, centre array<double>, radius double")
    points = spark.createDataFrame([(0, 0.5, 0.0), (0, -4.0, 0.0), (0, 49.0, 0.0), (0, 26.0, 0.0)], "scene int, x double, y double")
    got = {x.x: x.ball for x in regions.containing_ball(points, balls, ["x", "y"], ["scene"]).collect()}
    assert got == {0.5: 2, -4.0: 1, 49.0: 3, 26.0: 3}


def test_queries_give_whole_results(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    found = QUERIES["discover_regions"](spark, SF).collect()
    assert len({(x.track_id, x.event_id) for x in found}) == len(found) == n and all(x.region_id is not None for x in found)
    vectors = QUERIES["hierarchical_baseline"](spark, SF)
    assert vectors.where(F.col("cluster").isNull()).count() == 0
    grid = QUERIES["dbscan_grid"](spark, SF).collect()
    assert len(grid) == 16 and all(sum(x.best for x in grid if x.scene == s) <= 1 for s in range(4))
    by_scene = QUERIES["spectral_clusters"](spark, SF).collect()
    assert {x.scene for x in by_scene} == set(range(4)) and sum(x.points for x in by_scene) == n
    assert {x.k > 0 for x in QUERIES["choose_k_eigengap"](spark, SF).collect()} == {True}
    balls = regions.scene_balls(_tables(spark), ["scene"])
    labelled = QUERIES["recursive_spectral"](spark, SF).collect()
    assert len(labelled) == ball_table(*balls, ["scene"]).count()


def _tables(spark):
    from trekspark.plans.registry import Tables

    return Tables(spark, SF)


def test_graphs_of_balls_are_spread_and_labelled_like_their_edges(spark):
    r = np.random.default_rng(4)
    rows = [(s, k, [float(x) for x in r.normal(size=2) * 0.05 + 3 * np.array([k % 3, k % 2])], 0.05 + k / 1000) for s in range(2) for k in range(30)]
    balls = regions.stored(spark.createDataFrame(rows, "scene int, ball long, centre array<double>, radius double"))
    assert regions._graphs(balls, ["scene"], (0.3, 0.8)).rdd.getNumPartitions() >= 4  # few bytes, but no task gets all graphs
    bounds = spark.createDataFrame([(0, 2, 8, 6), (1, 2, 8, 6)], "scene int, k_low int, k_high int, least int")
    keys = ["scene", "delta"]
    edges = regions.with_loops(regions.affinity_edges(balls, ["scene"], (0.3, 0.8)), balls, keys)
    groups = lambda df: {frozenset(x.m) for x in df.groupBy(*keys, "cluster").agg(F.collect_set(F.struct("scene", "delta", "ball")).alias("m")).collect()}
    assert groups(regions.ball_clusters(balls, ["scene"], (0.3, 0.8), bounds)) == groups(regions.recursive_spectral(edges, keys, bounds))


def test_nearest_centres_by_product_are_those_by_differences():
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 7))
    c = np.concatenate([v[:5], v[:5], v[5:9] + 1e-9, r.normal(size=(9, 7))])  # equal centres: the first
    assert (regions.nearest_centres(v, c) == ((v[:, None] - c) ** 2).sum(2).argmin(1)).all()


def test_weights_count_as_copies(spark):
    rows = [(0, k % 3, float(k % 3 * 5 + k % 2), float(k % 5), 1 + k % 4) for k in range(24)]
    few = spark.createDataFrame(rows, "scene int, cluster int, x double, y double, n int")
    many = few.withColumn("_i", F.explode(F.sequence(F.lit(1), "n"))).drop("_i")
    one, two = (x.first() for x in (regions.composite_score(few, ["x", "y"], ["scene"], "cluster", "n"), regions.composite_score(many, ["x", "y"], ["scene"], "cluster")))
    assert [*one] == pytest.approx([*two])


def test_recursive_spectral_makes_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(regions, "affinity_edges", None)
    assert QUERIES["recursive_spectral"](spark, SF).count() > 0


@pytest.mark.parametrize("most", [20_000_000, 4_000])  # of one basis, and cut back many times
def test_leading_vectors_are_those_of_the_whole_matrix(monkeypatch, most):
    """Equal and close eigenvalues, a graph in parts, few rows."""
    monkeypatch.setattr(regions, "BASIS", most)
    r = np.random.default_rng(0)
    turn = np.linalg.qr(r.normal(size=(200, 200)))[0]
    values = np.r_[[2.0] * 4, 1.995, 1.99, np.linspace(0, 1.98, 194)]
    for w, k in (((turn * values) @ turn.T, 4), ((turn * values) @ turn.T, 6), (np.eye(120), 3), (np.diag([2.0, 1.0, 0.0]), 5)):
        seen = []
        got, x = regions.leading_vectors(lambda y: seen.append(1) or w @ y, len(w), k)
        k = min(k, len(w))
        assert got == pytest.approx(np.linalg.eigvalsh(w)[::-1][:k], abs=1e-9) and np.abs(w @ x - x * got).max() < 1e-8
        assert np.abs(x.T @ x - np.eye(k)).max() < 1e-8 and len(seen) < 200
