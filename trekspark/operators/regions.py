"""Regions: spectral clusters of ball graphs, their search over delta and k, and the whole way from stays to regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.graph import TASK_ROWS, discard, stored
from trekspark.operators.balls import ball_table, split_balls_by_radius, split_balls_median
from trekspark.operators.learned import ball_affinity
from trekspark.operators.spatial import dbscan
from trekspark.operators.trajectory import NEAREST_SQL, nearest_centroid
from trekspark.plans.registry import query

DELTAS = tuple(round(0.1 * k, 1) for k in range(1, 11))
NUMBERS = 4_000_000  # that k-means in a task holds at once
SOLVED = 100  # nodes of a graph up to which the driver solves it
BASIS = 20_000_000  # numbers of a basis that the driver holds
SAMPLE = 5_000  # stays of a scene that regions are fitted on; a graph has at most a tenth as many balls


# Graphs of balls


def _apart(a: str, b: str) -> Column:
    """Distance of two centres, given as arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def affinity_edges(balls: DataFrame, keys: list[str], deltas: tuple = DELTAS) -> DataFrame:
    """(keys, delta, a, b, w), a < b: the affinity of all pairs of balls of a key, for each delta."""
    side = lambda k: balls.select(*keys, *(F.col(c).alias(f"{k}_{c}") for c in ("ball", "centre", "radius")))
    met = side("a").join(side("b"), keys).where("a_ball < b_ball").withColumn("_d", _apart("a_centre", "b_centre"))
    each = met.withColumn("delta", F.explode(F.array(*(F.lit(float(d)) for d in deltas))))
    return each.select(*keys, "delta", F.col("a_ball").alias("a"), F.col("b_ball").alias("b"), ball_affinity(F.col("_d"), F.col("a_radius"), F.col("b_radius"), F.col("delta")).alias("w"))


def rbf_affinity(points: DataFrame, keys: list[str], key: str, gammas: tuple) -> DataFrame:
    """(keys, gamma, a, b, w), a < b: exp(-gamma d^2) of each pair of a key's points (v array<double>), for each gamma. For
    samples: rows grow with the square of a key's points."""
    side = lambda k: points.select(*keys, F.col(key).alias(k), F.col("v").alias(f"v_{k}"))
    met = side("a").join(side("b"), keys).where("a < b").withColumn("_d", _apart("v_a", "v_b"))
    return met.withColumn("gamma", F.explode(F.array(*(F.lit(float(g)) for g in gammas)))).select(*keys, "gamma", "a", "b", F.exp(-F.col("gamma") * F.col("_d") * F.col("_d")).alias("w"))


_MEANS = "me AS (SELECT label, [avg(embedding[1]), avg(embedding[2]), avg(embedding[3])] AS v FROM embeddings GROUP BY label)"


@query("rbf_affinity", f"WITH {_MEANS} SELECT x.label AS a, y.label AS b, CAST(g AS DOUBLE) AS gamma, round(exp(-g * ((x.v[1] - y.v[1]) * (x.v[1] - y.v[1]) + (x.v[2] - y.v[2]) * (x.v[2] - y.v[2]) + (x.v[3] - y.v[3]) * (x.v[3] - y.v[3]))), 6) AS w FROM me x JOIN me y ON x.label < y.label CROSS JOIN (VALUES (1e0), (3e0), (10e0), (30e0)) AS k(g)")
def _(t):
    means = t.embeddings.groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[k].cast("double")) for k in range(3))).alias("v"))
    return rbf_affinity(means.withColumn("part", F.lit(0)), ["part"], "label", (1, 3, 10, 30)).select("a", "b", "gamma", F.round("w", 6).alias("w"))


def spectral_embedding(edges: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(node, v) with the entries of the ``k`` leading eigenvectors of the normalised affinity, and the eigenvalues of the
    normalised Laplacian, smallest first.

    ``edges``: a, b, w of one graph, each pair once; ``nodes``: node. A node has affinity 1 with itself. The matrix is
    distributed by rows, the largest eigenvalues of I + D^-1/2 A D^-1/2 come from its products with blocks of vectors, a pass each. The driver holds
    BASIS numbers or some 4 k a node (beyond SOLVED nodes; smaller matrices are solved there).
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("w > 0")
    both = both.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("w")))
    numbered = nodes.select("node").rdd.map(lambda r: r.node).zipWithIndex()
    place = stored(nodes.sparkSession.createDataFrame(numbered, f"node {nodes.schema['node'].dataType.simpleString()}, i long"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d")).join(place, F.col("a") == F.col("node")).select("node", "i", "d")
    left, right = degree.select(F.col("node").alias("a"), "i", F.col("d").alias("di")), degree.select(F.col("node").alias("b"), F.col("i").alias("j"), F.col("d").alias("dj"))
    entries = both.join(left, "a").join(right, "b").select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj")) + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("v"))
    n = place.count()
    entries = stored(entries.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v").repartitionByRange("i").sortWithinPartitions("i"))
    if n <= SOLVED:
        found = entries.toPandas()
        w = np.zeros((n, n))
        w[found["i"], found["j"]] = found["v"]
        values, x = np.linalg.eigh(w)
        values, x = values[::-1][:k], x[:, ::-1][:, :k]
    else:
        values, x = leading_vectors(lambda y: _product(entries, y), n, k)
    discard(entries)
    spark = nodes.sparkSession
    some = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
    parts = [spark.createDataFrame(pa.table({"i": np.arange(at, min(n, at + TASK_ROWS)), "v": some(x[at : at + TASK_ROWS])}), "i long, v array<double>") for at in range(0, n, TASK_ROWS)]
    vectors = parts[0]
    for more in parts[1:]:
        vectors = vectors.unionByName(more)
    return vectors.join(place, "i").select("node", "v"), (2.0 - values).tolist()


def _product(entries: DataFrame, x: np.ndarray) -> np.ndarray:
    """A symmetric matrix (i, j, v; sorted by i in each part) times the columns of ``x``: each task sums its rows, the driver puts them together."""
    held = entries.sparkSession.sparkContext.broadcast(x)
    names = [f"y{c}" for c in range(x.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j, v = (c.to_numpy() for c in batch.columns)
                first = np.flatnonzero(np.diff(i, prepend=-1))
                y = np.add.reduceat(v[:, None] * held.value[j], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(i[first]), *(pa.array(c) for c in y.T)], ["i", *names])

    parts = entries.mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in names)])).toArrow()
    held.destroy()
    out, at = np.zeros(x.shape), parts["i"].to_numpy()
    for c, name in enumerate(names):
        out[:, c] = np.bincount(at, parts[name].to_numpy(), len(x))
    return out


def leading_vectors(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0, tolerance: float = 1e-9, rounds: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix of ``n`` rows and their vectors, by block Lanczos from a few more columns than asked, so that equal
    eigenvalues are all found; the basis is kept orthogonal and is cut back to its best vectors once it holds BASIS numbers or 256 columns."""
    k = min(k, n)
    wide = min(n, k + 4)
    most = max(4 * wide, min(256, BASIS // n))
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, wide)))[0]
    q, image = np.empty((n, 0)), np.empty((n, 0))
    for _ in range(rounds):
        q, image = np.hstack([q, new]), np.hstack([image, product(new)])
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x = q @ turn[:, :k]
        if q.shape[1] >= k and np.linalg.norm(image @ turn[:, :k] - x * values[:k], axis=0).max() <= tolerance:
            return values[:k], x
        rest = image[:, -new.shape[1] :]
        for _ in range(2):
            rest = rest - q @ (q.T @ rest)
        new, size, _ = np.linalg.svd(rest, full_matrices=False)
        new = new[:, size > 1e-11]
        if not new.shape[1]:
            return values[:k], x
        if q.shape[1] + new.shape[1] > most:
            kept = turn[:, : max(2 * wide, most // 3)]
            q, image = q @ kept, image @ kept
        new = np.linalg.qr(new - q @ (q.T @ new))[0]
    raise RuntimeError(f"eigenvectors not found in {rounds} rounds")


def spectral_clusters(edges: DataFrame, nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(node, cluster): k-means clusters of the rows of the ``k`` leading eigenvectors, each of unit length."""
    vectors, _ = spectral_embedding(edges, nodes, k)
    unit = F.udf(lambda v: Vectors.dense(np.asarray(v) / max(np.linalg.norm(v), 1e-300)), VectorUDT())  # one row a ball
    rows = stored(vectors.select("node", "v")).select("node", unit("v").alias("features"))
    return KMeans(k=k, seed=seed, initSteps=5, maxIter=100).fit(rows).transform(rows).select("node", F.col("prediction").alias("cluster"))


def scene_balls(t, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """All points with the balls that they fall into, by place alone."""
    p = t.fx_p.select("track_id", "event_id", "scene", (F.col("lon") * 1e3).alias("x"), (F.col("lat") * 1e3).alias("y"))
    return stored(split_balls_median(p, ["x", "y"], keys)), ["x", "y"]


@query("spectral_clusters")
def _(t):
    """Clusters of all balls in one graph; scenes lie far apart, so each is a cluster of its own."""
    points, features = scene_balls(t, [])
    balls = stored(ball_table(points.withColumn("part", F.lit(0)), features, ["part"]))
    edges = stored(affinity_edges(balls, ["part"], (0.5,)).where("w > 1e-6"))
    labels = spectral_clusters(edges, balls.select(F.col("ball").alias("node")), 4)
    held = points.groupBy(F.col("ball").alias("node"), "scene").agg(F.count("*").alias("n"))
    return labels.join(held, "node").groupBy("cluster", "scene").agg(F.countDistinct("node").alias("balls"), F.sum("n").alias("points"))


# Graphs that one task holds: many scenes and deltas at once, each with the balls of a bounded sample


def laplacian(w: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(w.sum(1), 1e-10))
    out = w * scale[:, None]  # the only other matrix of this size
    out *= scale[None]
    np.negative(out, out=out)
    out[np.diag_indices(len(w))] += 1
    return out


def eigengap_k(values: np.ndarray, k_low: int, k_high: int) -> int:
    """The k of the largest gap after the k-th smallest eigenvalue, k_low <= k < k_high; 1 where there is no choice."""
    n = len(values)
    k_high = min(k_high, n - 1)
    gaps = np.diff(values[: k_high + 1])
    first, last = max(0, k_low - 1), min(len(gaps), k_high - 1)
    if n < 3 or k_low >= k_high or first >= last:
        return 1
    return int(min(max(k_low, first + int(gaps[first:last].argmax()) + 1), k_high))


def nearest_centres(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` to each row, ties to the first: squared distances less the row's own by one matrix product, and by
    differences where rounding leaves two centres."""
    out, square = np.empty(len(v), np.int64), (centres**2).sum(1)
    near = 1e-12 * (1 + square.max() + (v**2).sum(1)) * v.shape[1]
    step = max(1, NUMBERS // len(centres))
    for a in range(0, len(v), step):
        d = square - 2 * (v[a : a + step] @ centres.T)
        out[a : a + step] = d.argmin(1)
        for i in np.flatnonzero((d <= d.min(1, keepdims=True) + near[a : a + step, None]).sum(1) > 1):
            out[a + i] = ((v[a + i] - centres) ** 2).sum(1).argmin()
    return out


def nearest_groups(v: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """k-means labels in order of appearance, from centres that lie far apart: the longest row, then each time the row farthest from all."""
    seeds = [int((v**2).sum(1).argmax())]
    gap = ((v - v[seeds[0]]) ** 2).sum(1)
    while len(seeds) < k:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, ((v - v[seeds[-1]]) ** 2).sum(1))
    centres, labels = v[seeds], None
    for _ in range(rounds):
        new = nearest_centres(v, centres)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.array([v[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
    first = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([first[c] for c in labels.tolist()])


def recursive_labels(w: np.ndarray, k_low: int, k_high: int, least: int, deeper: tuple[int, int] = (2, 2)) -> np.ndarray:
    """Labels of a graph's nodes: k by the eigengap within the range, then each cluster of ``least`` nodes or more again, with
    the range ``deeper``: (2, 2) leaves no choice, so clusters stay; (2, 3) splits in two. Clusters only shrink, so the depth
    is bounded by the number of nodes."""
    n = len(w)
    if n < max(least, 3) or k_low >= min(k_high, n - 1):  # no choice of k: no need of eigenvalues
        return np.zeros(n, int)
    values, vectors = np.linalg.eigh(laplacian(w))
    k = eigengap_k(values, k_low, k_high)
    if k <= 1:
        return np.zeros(n, int)
    rows = vectors[:, :k].copy(order="K")
    del vectors
    groups = nearest_groups(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300), k)
    labels, next_ = np.zeros(n, int), 0
    for c in range(groups.max() + 1):
        own = np.flatnonzero(groups == c)
        inner = recursive_labels(w[np.ix_(own, own)], *deeper, least, deeper) if len(own) < n else np.zeros(len(own), int)
        labels[own] = inner + next_
        next_ += inner.max() + 1
    return labels


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and the affinity of a graph given as edges; a loop (a = b) names a node without others."""
    nodes = np.unique(np.concatenate([group["a"].to_numpy(), group["b"].to_numpy()]))
    w = np.eye(len(nodes))
    i, j = np.searchsorted(nodes, group["a"].to_numpy()), np.searchsorted(nodes, group["b"].to_numpy())
    inner = i != j
    w[i[inner], j[inner]] = w[j[inner], i[inner]] = np.nan_to_num(np.maximum(group["w"].to_numpy()[inner], 0))
    return nodes, w


def ball_matrix(centres: np.ndarray, radii: np.ndarray, delta: float) -> np.ndarray:
    """The affinity of all pairs of balls, as ``affinity_edges`` gives it for balls in this order, in blocks of rows; 1 on the diagonal."""
    n = len(radii)
    w, at = np.empty((n, n)), np.arange(n)
    step = max(1, NUMBERS // (8 * max(1, n)))
    with np.errstate(all="ignore"):
        for a in range(0, n, step):
            own = at[a : a + step, None]
            r1, r2 = radii[np.minimum(own, at)], radii[np.maximum(own, at)]
            d = np.sqrt(sum((c[own] - c[at]) ** 2 for c in centres.T))
            small, large = np.minimum(r1, r2), np.maximum(r1, r2)
            even = 1 - np.abs(r1 - r2) / large
            near = np.minimum(0.7 + 0.3 * np.minimum((r1 + r2 - d) / (2 * small), 1.0) + 0.1 * (d + small <= large) + 0.05 * even, 1.0)
            apart = np.exp(-((d - r1 - r2) / (r1 + r2)) / (delta * (0.5 + 0.5 * even))) * (0.7 + 0.3 * even)
            w[a : a + step] = np.nan_to_num(np.maximum(np.where(small <= 0, np.exp(-10 * d), np.where(d <= r1 + r2, near, apart)), 0))
    w[at, at] = 1.0
    return w


def _graphs(balls: DataFrame, keys: list[str], deltas: tuple) -> DataFrame:
    """Balls once for each delta: a graph's task gets a row a ball and works out the pairs itself, no table of pairs is shuffled. The rows are few and
    the work is much, so graphs are spread over tasks by their number: by bytes all of them would be one task's."""
    tasks = 4 * len(deltas) * max(1, balls.select(*keys).distinct().count())
    return balls.withColumn("delta", F.explode(F.array(*(F.lit(float(d)) for d in deltas)))).repartition(tasks, *keys, "delta")


def _ball_graph(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    group = group.sort_values("ball")
    return group["ball"].to_numpy(), ball_matrix(np.stack(group["centre"]).astype(float), group["radius"].to_numpy(float), float(group["delta"].iloc[0]))


def ball_eigenvalues(balls: DataFrame, keys: list[str], deltas: tuple) -> DataFrame:
    """``graph_eigenvalues`` of the graphs of all balls of a key (keys, ball, centre, radius), for each delta."""
    by = [*keys, "delta"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(laplacian(_ball_graph(group)[1]))
        return pd.DataFrame({**{k: group[k].iloc[0] for k in by}, "i": np.arange(len(values)), "value": values})

    graphs = _graphs(balls, keys, deltas)
    return graphs.groupBy(*by).applyInPandas(run, _schema(graphs, by, "i int, value double"))


def with_loops(edges: DataFrame, balls: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with a loop for each ball and each value of the last key, so that a lone ball is a graph too."""
    values = edges.select(*keys).distinct()
    loops = balls.select(*[c for c in keys if c in balls.columns], F.col("ball").alias("a"), F.col("ball").alias("b"), F.lit(1.0).alias("w"))
    return edges.select(*keys, "a", "b", "w").unionByName(loops.join(values, [c for c in keys if c in balls.columns]).select(*keys, "a", "b", "w"))


def graph_eigenvalues(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, value): the eigenvalues of each graph's normalised Laplacian from the smallest (i = 0) on. A graph is one task's."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(laplacian(_matrix(group)[1]))
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "i": np.arange(len(values)), "value": values})

    return edges.groupBy(*keys).applyInPandas(run, _schema(edges, keys, "i int, value double"))


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), more])


def choose_k_eigengap(values: DataFrame, keys: list[str], k_low: Column | int, k_high: Column | int) -> DataFrame:
    """(keys, k): the position of the largest gap between neighbouring eigenvalues, k_low <= k < k_high, ties to the smaller; 1
    where there is no choice. ``values``: keys, i (from 0), value."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (k_low, k_high))
    by = Window.partitionBy(*keys)
    w = values.withColumns({"_n": F.count("*").over(by), "_gap": F.lead("value").over(by.orderBy("i")) - F.col("value")}).withColumns({"_low": low, "_high": F.least(high, F.col("_n") - 1)})
    inside = (F.col("i") >= F.greatest(F.lit(0), F.col("_low") - 1)) & (F.col("i") < F.least(F.col("_high"), F.col("_high") - 1)) & F.col("_gap").isNotNull() & (F.col("_n") >= 3) & (F.col("_low") < F.col("_high"))
    best = w.groupBy(*keys).agg(F.max(F.when(inside, F.struct("_gap", (-F.col("i")).alias("i"), "_low", "_high"))).alias("b"))
    return best.select(*keys, F.coalesce(F.greatest("b._low", F.least(1 - F.col("b.i"), F.col("b._high"))), F.lit(1)).cast("int").alias("k"))


def recursive_spectral(edges: DataFrame, keys: list[str], bounds: DataFrame, deeper: tuple[int, int] = (2, 2)) -> DataFrame:
    """(keys, ball, cluster): recursive spectral clusters of each graph, the range of k within clusters being ``deeper``. ``bounds``: k_low, k_high and least per key (those of its columns
    that are keys). Graphs are split among tasks; one has the balls of a bounded sample."""
    on = [k for k in keys if k in bounds.columns]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _matrix(group)
        labels = recursive_labels(w, *(int(group[c].iloc[0]) for c in ("k_low", "k_high", "least")), deeper)
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "ball": nodes, "cluster": labels})

    return edges.join(bounds, on).groupBy(*keys).applyInPandas(run, _schema(edges, keys, f"ball {edges.schema['a'].dataType.simpleString()}, cluster int"))


def ball_clusters(balls: DataFrame, keys: list[str], deltas: tuple, bounds: DataFrame, deeper: tuple[int, int] = (2, 2)) -> DataFrame:
    """``recursive_spectral`` of the graphs of all balls of a key (keys, ball, centre, radius), for each delta: (keys, delta, ball, cluster)."""
    by = [*keys, "delta"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _ball_graph(group)
        labels = recursive_labels(w, *(int(group[c].iloc[0]) for c in ("k_low", "k_high", "least")), deeper)
        return pd.DataFrame({**{k: group[k].iloc[0] for k in by}, "ball": nodes, "cluster": labels})

    graphs = _graphs(balls.join(bounds, keys), keys, deltas)
    return graphs.groupBy(*by).applyInPandas(run, _schema(graphs, by, f"ball {balls.schema['ball'].dataType.simpleString()}, cluster int"))


def k_bounds(df: DataFrame, regions: str, balls: str, rule: str) -> DataFrame:
    """``df`` with k_low and k_high, from the POI regions of a scene (null: none known) and its balls.

    ``rule``: "poi" (both ends follow the regions), "train" (fitted without a look at test tracks; from the balls where
    regions are fewer than three) or "scene" (whole scenes; from 2 to a quarter of the balls without regions).
    """
    r, n = F.coalesce(F.col(regions), F.lit(0)), F.col(balls)
    least, most = F.least, F.greatest
    lit = F.lit
    if rule == "train":
        known = r >= 3
        low = F.when(known, most(lit(3), r - 2)).otherwise(most(lit(12), F.floor(n / 20)))
        high = F.when(known, least(n, most(lit(12), r + 4))).otherwise(least(n, most(lit(40), F.floor(n / 8))))
        high = least(most(high, low + 1), n)
        low = most(lit(3), least(low, high - 1))
    else:
        low, high = most(lit(2), r - 5), most(lit(12), r + 3)
        high = least(most(low + 1, high), most(lit(2), n))
        low = most(lit(2), least(low, high - 1))
        if rule == "scene":
            free = least(most(lit(12), F.floor(n / 4)), n)
            high = F.when(r > 0, high).otherwise(F.when(free <= 2, most(lit(3), least(free + 1, n))).otherwise(free))
            low = F.when(r > 0, low).otherwise(lit(2))
            high = least(high, n)
            low = most(lit(2), least(low, high - 1))
    return df.withColumns({"k_low": low.cast("int"), "k_high": high.cast("int")})


K_BOUNDS_SQL = """, b1 AS (SELECT *, greatest(2, r - 5) AS lo, greatest(12, r + 3) AS hi FROM kb), b2 AS (SELECT *, least(greatest(lo + 1, hi), greatest(2, n)) AS h FROM b1),
t1 AS (SELECT *, CASE WHEN r >= 3 THEN greatest(3, r - 2) ELSE greatest(12, n // 20) END AS lo, CASE WHEN r >= 3 THEN least(n, greatest(12, r + 4)) ELSE least(n, greatest(40, n // 8)) END AS hi FROM kb), t2 AS (SELECT *, least(greatest(hi, lo + 1), n) AS h FROM t1)"""


@query("k_bounds", f"WITH kb AS (SELECT CAST(track_id % 40 AS INT) AS r, CAST(count(*) AS INT) AS n FROM fx_p GROUP BY track_id){K_BOUNDS_SQL} SELECT 'poi' AS rule, r, n, CAST(greatest(2, least(lo, h - 1)) AS INT) AS k_low, CAST(h AS INT) AS k_high FROM b2 UNION ALL SELECT 'train', r, n, CAST(greatest(3, least(lo, h - 1)) AS INT), CAST(h AS INT) FROM t2")
def _(t):
    counts = t.fx_p.groupBy("track_id").agg(F.count("*").cast("int").alias("n")).select((F.col("track_id") % 40).cast("int").alias("r"), "n")
    both = [k_bounds(counts, "r", "n", rule).withColumn("rule", F.lit(rule)) for rule in ("poi", "train")]
    return both[0].unionByName(both[1])


def graph_bounds(balls: DataFrame, keys: list[str], regions: DataFrame | None = None, rule: str = "train") -> DataFrame:
    """k_low, k_high and least (the balls from which a cluster is split again) per key."""
    n = balls.groupBy(*keys).agg(F.count("*").alias("_balls"))
    n = n.join(regions, keys, "left") if regions is not None else n.withColumn("regions", F.lit(None).cast("int"))
    return k_bounds(n, "regions", "_balls", rule).select(*keys, "k_low", "k_high", F.greatest(F.lit(8), F.floor(F.col("_balls") / 16)).alias("least"))


@query("choose_k_eigengap")
def _(t):
    points, features = scene_balls(t, ["scene"])
    balls = stored(ball_table(points, features, ["scene"]))
    values = ball_eigenvalues(balls, ["scene"], (0.5,))
    return choose_k_eigengap(values, ["scene", "delta"], 3, 40)


@query("recursive_spectral")
def _(t):
    points, features = scene_balls(t, ["scene"])
    balls = stored(ball_table(points, features, ["scene"]))
    return ball_clusters(balls, ["scene"], (0.5,), graph_bounds(balls, ["scene"]), (2, 3))


# Scores of labelled points


def _mean(x: Column, weight: str | None) -> Column:
    return F.avg(x) if weight is None else F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight)))


def cluster_spread(points: DataFrame, features: list[str], keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    """Per cluster: centre, n, the mean squared distance from it (var) and the mean distance (spread). A row counts as often as its
    ``weight`` says, once without it."""
    centre = points.groupBy(*keys, label).agg(*(_mean(F.col(f), weight).alias(f"_m_{f}") for f in features))
    square = sum(((F.col(f) - F.col(f"_m_{f}")) ** 2 for f in features), F.lit(0.0))
    n = F.count("*") if weight is None else F.sum(weight)
    return points.join(centre, [*keys, label]).groupBy(*keys, label).agg(F.array(*(F.first(f"_m_{f}") for f in features)).alias("centre"), n.alias("n"), _mean(square, weight).alias("var"), _mean(F.sqrt(square), weight).alias("spread"))


def silhouette(points: DataFrame, features: list[str], keys: list[str], label: str, clusters: DataFrame, weight: str | None = None) -> DataFrame:
    """(keys, silhouette): the mean silhouette by squared distances, which is exact in one pass: the mean squared distance of a point
    to a cluster is that to its centre plus its var. A point alone in its cluster counts 0; clusters of a key travel as one array."""
    listed = clusters.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre", "n", "var")).alias("_c"))
    place = F.array(*(F.col(f).cast("double") for f in features))
    to = lambda c: F.aggregate(F.zip_with(c["centre"], place, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) + c["var"]
    seen = F.transform("_c", lambda c: F.struct((c["label"] == F.col(label)).alias("own"), to(c).alias("d"), c["n"].alias("n")))
    met = points.join(listed, keys).withColumn("_s", seen)
    own = F.get(F.filter("_s", lambda c: c["own"]), F.lit(0))
    a, b = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0)), F.array_min(F.transform(F.filter("_s", lambda c: ~c["own"]), lambda c: c["d"]))
    score = F.when(own["n"] > 1, F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return met.groupBy(*keys).agg(_mean(score, weight).alias("silhouette"))


def composite_score(points: DataFrame, features: list[str], keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    """(keys, k, silhouette, balance, separation, score): half the silhouette on 0 to 1, a fifth the entropy of sizes over its largest
    value, three tenths the smallest gap of centres over the mean spread (at most 1). One cluster scores 0. Rows without a label do not count,
    others as often as ``weight`` says."""
    labelled = points.where(F.col(label).isNotNull())
    c = stored(cluster_spread(labelled, features, keys, label, weight))
    sil = silhouette(labelled, features, keys, label, c, weight)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    sums = c.withColumn("_p", share).groupBy(*keys).agg(F.count("*").alias("k"), (-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-12))).alias("_h"), F.avg(F.when(F.col("n") > 1, F.col("spread"))).alias("_in"))
    other = c.select(*keys, F.col(label).alias("_l"), F.col("centre").alias("_o"))
    pairs = c.join(other, keys).where(F.col(label) < F.col("_l"))  # centres of a key
    gaps = pairs.groupBy(*keys).agg(F.min(_apart("centre", "_o")).alias("_gap"))
    met = sums.join(sil, keys).join(gaps, keys, "left")
    within = F.coalesce("_in", F.lit(1.0))
    out = met.withColumns({"balance": F.col("_h") / F.nullif(F.log("k"), F.lit(0.0)), "separation": F.when(within > 0, F.least(F.lit(1.0), F.col("_gap") / (within + 1e-12))).otherwise(0.0)})
    score = 0.5 * (F.col("silhouette") + 1) / 2 + 0.2 * F.col("balance") + 0.3 * F.col("separation")
    one = F.col("k") < 2
    zero = lambda x: F.when(one, 0.0).otherwise(x)
    return out.select(*keys, "k", zero(F.col("silhouette")).alias("silhouette"), zero(F.col("balance")).alias("balance"), zero(F.col("separation")).alias("separation"), zero(score).alias("score"))


SCORE_SQL = f"""{NEAREST_SQL.format(src='fx_p')}, pt AS (SELECT scene, region_id, track_id, event_id, lon * 1e3 AS x, lat * 1e3 AS y FROM nc), ce AS (SELECT scene, region_id, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pt GROUP BY 1, 2),
cl AS (SELECT p.scene, p.region_id, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, avg((x - mx) * (x - mx) + (y - my) * (y - my)) AS var, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS spread FROM pt p JOIN ce USING (scene, region_id) GROUP BY 1, 2),
sp AS (SELECT p.scene, p.track_id, p.event_id, max(CASE WHEN c.region_id = p.region_id THEN n END) AS n, max(CASE WHEN c.region_id = p.region_id THEN ((x - mx) * (x - mx) + (y - my) * (y - my) + var) * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN c.region_id <> p.region_id THEN (x - mx) * (x - mx) + (y - my) * (y - my) + var END) AS b FROM pt p JOIN cl c USING (scene) GROUP BY 1, 2, 3),
si AS (SELECT scene, avg(CASE WHEN n > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END) AS sil FROM sp GROUP BY 1), pr AS (SELECT *, n / sum(n) OVER (PARTITION BY scene) AS p FROM cl),
ba AS (SELECT scene, count(*) AS k, -sum(p * ln(p + 1e-12)) / ln(count(*)) AS bal, avg(CASE WHEN n > 1 THEN spread END) AS win FROM pr GROUP BY 1), ga AS (SELECT x.scene, min(sqrt((x.mx - y.mx) * (x.mx - y.mx) + (x.my - y.my) * (x.my - y.my))) AS gap FROM cl x JOIN cl y ON x.scene = y.scene AND x.region_id < y.region_id GROUP BY 1),
sco AS (SELECT scene, k, sil, bal, least(1e0, gap / (win + 1e-12)) AS sep FROM si JOIN ba USING (scene) JOIN ga USING (scene))"""


@query("composite_score", f"WITH {SCORE_SQL} SELECT scene, k, round(sil, 5) AS silhouette, round(bal, 5) AS balance, round(sep, 5) AS separation, round(25e-2 * (sil + 1) + 2e-1 * bal + 3e-1 * sep, 5) AS score FROM sco")
def _(t):
    points = nearest_centroid(t.fx_p, t.fx_c).select("scene", "region_id", (F.col("lon") * 1e3).alias("x"), (F.col("lat") * 1e3).alias("y"))
    s = composite_score(points, ["x", "y"], ["scene"], "region_id")
    return s.select("scene", "k", *(F.round(c, 5).alias(c) for c in ("silhouette", "balance", "separation", "score")))


# Search and discovery


def containing_ball(points: DataFrame, balls: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``points`` with ball: the smallest one that holds the point, else the one with the nearest centre; ties to the smaller id, which a
    point without a place has too. Points of a key are dealt into parts of about TASK_ROWS, each of which meets the key's balls in one task."""
    parts = points.groupBy(*keys).agg(F.ceil(F.count("*") / TASK_ROWS).alias("_parts"))
    others = [c for c in points.columns if c != "ball"]
    dealt = points.select(*others).join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*others), F.col("_parts"))).drop("_parts")
    listed = balls.join(parts, keys).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "ball", "centre", "radius")

    def run(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("ball")
        at = nearest_balls(some[features].to_numpy(float), np.stack(near["centre"]).astype(float), near["radius"].to_numpy(float)) if len(some) and len(near) else []
        return some.iloc[: len(at)][others].assign(ball=near["ball"].to_numpy()[at])

    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in others), f"ball {balls.schema['ball'].dataType.simpleString()}"])
    return dealt.groupBy(*keys, "_part").cogroup(listed.groupBy(*keys, "_part")).applyInPandas(run, schema)


def nearest_balls(x: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each point the index of the ball that ``containing_ball`` chooses, balls being in the order of their ids."""
    out = np.empty(len(x), np.int64)
    step = max(1, NUMBERS // (4 * len(radii)))
    for a in range(0, len(x), step):
        d = np.sqrt(sum((p[a : a + step, None] - c) ** 2 for p, c in zip(x.T, centres.T)))
        d[np.isnan(d)] = np.inf
        held = np.where(d <= radii, radii, np.inf)
        out[a : a + step] = np.where(np.isfinite(held.min(1)), held.argmin(1), d.argmin(1))
    return out


def delta_scores(points: DataFrame, balls: DataFrame, features: list[str], keys: list[str], bounds: DataFrame, deltas: tuple = DELTAS, id_cols: tuple = ("track_id", "event_id")) -> tuple[DataFrame, DataFrame]:
    """Scores (keys, delta, k, silhouette, ..., score) over a fixed 70 % of the points, and labels (keys, delta, ball, cluster). All
    deltas of all keys are one set of jobs: a point's ball is found once, its label once a delta."""
    labels = stored(ball_clusters(balls, keys, deltas, bounds))
    places = points.where(F.pmod(F.xxhash64(*id_cols), F.lit(10)) < 7).groupBy(*keys, *features).agg(F.count("*").alias("_n"))  # points at one place count as one row
    part = stored(containing_ball(places, balls, features, keys))
    return composite_score(part.join(labels, [*keys, "ball"]), features, [*keys, "delta"], "cluster", "_n"), labels


def grid_search_delta(scores: DataFrame, keys: list[str], by: str = "score") -> DataFrame:
    """(keys, delta, k, ``by``): the best delta of each key, ties to the smallest; a key without two clusters at any delta has 0.5 and k 1."""
    best = scores.groupBy(*keys).agg(F.max(F.when(F.col("k") > 1, F.struct(F.col(by).alias("s"), (-F.col("delta")).alias("d"), "k"))).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.d"), F.lit(0.5)).alias("delta"), F.coalesce("b.k", F.lit(1)).alias("k"), F.col("b.s").alias(by))


def _sampled(points: DataFrame, keys: list[str], most: int, id_cols: tuple) -> DataFrame:
    """At most about ``most`` rows of each key by a hash of their ids: the documented sample that balls are fitted on."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(*id_cols), F.lit(1_000_003)) / 1_000_003
    return points.join(n, keys).where(share < most / F.col("_n")).select(*points.columns)


def fit_regions(points: DataFrame, sample: int = SAMPLE, deltas: tuple = DELTAS, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A scene's regions from its stays: (model, centroids).

    ``points``: track_id, event_id, scene, lon, lat, ele, stop (boolean). The places of stays are
    scaled to 0 to 1 by their smallest and largest values (so metres would give the same), at most about ``sample`` of a scene; they are split into balls by
    median and radius, delta and k are searched, and a region is the mean of its stays. model: scene, the scale, delta, k, balls; centroids:
    scene, region_id (from 0), u, v, w. Only ``points`` are looked at, so a model of train tracks knows nothing of others.
    """
    features = ["u", "v", "w"]
    stays = points.where("stop AND lon IS NOT NULL AND lat IS NOT NULL AND ele IS NOT NULL")
    fit = stays.groupBy("scene").agg(*(f(c).alias(f"{n}_{c}") for c in ("lon", "lat", "ele") for n, f in (("lo", F.min), ("hi", F.max))))
    fit = stored(fit)
    scaled = stored(_sampled(scale_points(stays, fit), ["scene"], sample, ("track_id", "event_id")).select("track_id", "event_id", "scene", *features))
    split = stored(split_balls_by_radius(split_balls_median(scaled, features, ["scene"]), features, ["scene"]))
    balls = stored(ball_table(split, features, ["scene"]))
    bounds = stored(graph_bounds(balls, ["scene"], regions))
    scores, labels = delta_scores(scaled, balls, features, ["scene"], bounds, deltas)
    best = stored(grid_search_delta(scores, ["scene"], "silhouette"))
    chosen = labels.join(best.select("scene", "delta"), ["scene", "delta"])
    named = containing_ball(scaled, balls, features, ["scene"]).join(chosen, ["scene", "ball"])
    centre = named.groupBy("scene", "cluster").agg(*((F.sum(F.col(f).cast("decimal(28,18)")).cast("double") / F.count("*")).alias(f) for f in features), F.count("*").alias("stays"))  # sums of decimals do not hang on the order of rows
    centroids = centre.withColumn("region_id", F.row_number().over(Window.partitionBy("scene").orderBy("cluster")) - 1).drop("cluster")
    count = balls.groupBy("scene").agg(F.count("*").alias("balls"))
    return stored(fit.join(best, "scene").join(count, "scene")), stored(centroids.select("scene", "region_id", *features, "stays"))


def scale_points(points: DataFrame, model: DataFrame) -> DataFrame:
    """``points`` with u, v and w: longitude, latitude and elevation over the ranges of the model's stays."""
    m = model.select("scene", *(f"{n}_{c}" for c in ("lon", "lat", "ele") for n in ("lo", "hi")))
    part = lambda c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-9)
    return points.join(m, "scene").withColumns({"u": part("lon"), "v": part("lat"), "w": part("ele")}).select(*points.columns, "u", "v", "w")


def discover_regions(points: DataFrame, model: DataFrame, centroids: DataFrame) -> DataFrame:
    """``points`` with region_id: that of the nearest centroid in the model's scale (ties to the smaller id); null without a position."""
    listed = centroids.groupBy("scene").agg(F.collect_list(F.struct("region_id", "u", "v", "w")).alias("_c"))
    d = lambda c: (c["u"] - F.col("u")) ** 2 + (c["v"] - F.col("v")) ** 2 + (c["w"] - F.col("w")) ** 2
    best = F.array_min(F.transform("_c", lambda c: F.struct(d(c).alias("d"), c["region_id"].alias("id"))))
    there = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull()
    return scale_points(points, model).join(listed, "scene").select(*points.columns, F.when(there, best["id"]).alias("region_id"))


def slow_points(t) -> DataFrame:
    return t.fx_p.select("track_id", "event_id", "scene", "lon", "lat", "ele", (F.col("speed_kmh") <= 5).alias("stop"))


@query("discover_regions")
def _(t):
    """Regions fitted on the stays of train tracks, given to the points of all tracks."""
    points = slow_points(t)
    return discover_regions(points, *fit_regions(points.where("track_id % 10 < 7"))).select("track_id", "event_id", "scene", "region_id")


@query("grid_search_delta")
def _(t):
    points, features = scene_balls(t, ["scene"])
    balls = stored(ball_table(points, features, ["scene"]))
    scores, _ = delta_scores(points.drop("ball"), balls, features, ["scene"], graph_bounds(balls, ["scene"]))
    return grid_search_delta(scores, ["scene"]).withColumn("score", F.round("score", 4))


GRID_SQL = "sw AS (SELECT target AS scene, (seed + 1) / 1e1 AS delta, mae_min AS score, CAST(2 + seed % 2 AS BIGINT) AS k FROM fx_res WHERE grp = 'full')"


@query("select_delta", f"WITH {GRID_SQL} SELECT scene, delta, k, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, delta) AS r FROM sw) WHERE r = 1")
def _(t):
    """The selection step alone, over a table of scores."""
    sweep = t.fx_res.where("grp = 'full'").select(F.col("target").alias("scene"), ((F.col("seed") + 1) / 10).alias("delta"), F.col("mae_min").alias("score"), (2 + F.col("seed") % 2).cast("long").alias("k"))
    return grid_search_delta(sweep, ["scene"]).withColumn("score", F.round("score", 6))


def dbscan_grid(points: DataFrame, eps: tuple, least: tuple, features: list[str]) -> DataFrame:
    """(scene, eps, least, k, noise, silhouette) of density clusters for each pair of parameters, and whether it is the scene's best: the
    largest silhouette of the points that are no noise (ties to smaller parameters)."""
    tables = []
    for e in eps:
        for m in least:
            tables.append(stored(dbscan(points, e, m).withColumns({"eps": F.lit(float(e)), "least": F.lit(m)})))
    labelled = tables[0]
    for x in tables[1:]:
        labelled = labelled.unionByName(x)
    keys = ["scene", "eps", "least"]
    noise = labelled.groupBy(*keys).agg(F.avg((F.col("cluster") == -1).cast("double")).alias("noise"))
    scores = composite_score(labelled.where("cluster != -1"), features, keys, "cluster").where("k > 1").select(*keys, "k", "silhouette")
    best = Window.partitionBy("scene").orderBy(F.desc_nulls_last("silhouette"), "eps", "least")
    return noise.join(scores, keys, "left").withColumn("best", (F.row_number().over(best) == 1) & F.col("silhouette").isNotNull())


@query("dbscan_grid")
def _(t):
    p = t.fx_p.select("scene", "track_id", "event_id", "lon", "lat", (F.col("lon") * 1e3).alias("x"), (F.col("lat") * 1e3).alias("y"))
    return dbscan_grid(p, (1.1e-4, 2.1e-4), (5, 20), ["x", "y"]).withColumns({"noise": F.round("noise", 6), "silhouette": F.round("silhouette", 4)})


def hierarchical_baseline(points: DataFrame, ks: tuple, seed: int = 0) -> DataFrame:
    """``points`` (v array<double>) with cluster: bisecting k-means, which splits top down where a merge tree of all points would not
    scale, with the k of the largest silhouette. Rows without a vector have a null cluster."""
    to_vector = F.udf(lambda v: Vectors.dense(v), VectorUDT())
    there = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    rows = stored(points.where(there)).withColumn("_x", to_vector("v"))
    scored = []
    for k in ks:
        labelled = BisectingKMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed).fit(rows).transform(rows)
        scored.append((ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(labelled), -k, labelled))
    best = max(scored, key=lambda s: s[:2])[2].drop("_x")
    return best.unionByName(points.where(~F.coalesce(there, F.lit(False))).withColumn("cluster", F.lit(None).cast("int")))


@query("hierarchical_baseline")
def _(t):
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return hierarchical_baseline(e, (5, 10, 15)).select("vec_id", "label", "cluster")
