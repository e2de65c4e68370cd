"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekspark.llm.common import components, discard, read_table, stored
from trekspark.llm.topk_search import usable

COSINE = 0.95
GRID_DIMENSIONS = 6
SEQUENCE_ROWS = 4096  # vectors in a sequence interval that a task holds
LEAF_ROWS = 128
SLACK = 1e-9


class Interval:
    """A run of unit vectors in epsilon grid order, with its box in the grid dimensions and its ball."""

    def __init__(self, unit: np.ndarray, grid: np.ndarray, first: int) -> None:
        self.unit, self.grid, self.first = unit, grid, first
        self.low, self.high = grid.min(axis=0), grid.max(axis=0)
        self.centre = unit.mean(axis=0)
        self.radius = float(np.sqrt(((unit - self.centre) ** 2).sum(axis=1).max()))
        self._halves: tuple[Interval, Interval] | None = None

    def halves(self) -> tuple[Interval, Interval]:
        if self._halves is None:
            m = len(self.unit) // 2
            self._halves = Interval(self.unit[:m], self.grid[:m], self.first), Interval(self.unit[m:], self.grid[m:], self.first + m)
        return self._halves


def ego_join(a: Interval, b: Interval, eps: float, cosine: float, found) -> None:
    """Report all pairs of ``a`` x ``b`` with cosine >= ``cosine``, an interval with itself in both orders.

    Two intervals are skipped if their boxes are farther apart than ``eps`` in the grid dimensions
    (projections only shorten distances) or their balls are; they are reported whole if no pair of
    their balls can be farther than ``eps``; else the longer one is halved, down to leaves whose
    cosines are evaluated. found(a, b, mask): mask None for a whole interval pair.
    """
    gap = np.maximum(np.maximum(a.low - b.high, b.low - a.high), 0)
    if np.sqrt((gap**2).sum()) > eps + SLACK:
        return
    apart = float(np.sqrt(((a.centre - b.centre) ** 2).sum()))
    if apart - a.radius - b.radius > eps + SLACK:
        return
    if apart + a.radius + b.radius < eps - SLACK:
        found(a, b, None)
        return
    if len(a.unit) <= LEAF_ROWS and len(b.unit) <= LEAF_ROWS:
        mask = a.unit @ b.unit.T >= cosine
        if mask.any():
            found(a, b, mask)
        return
    if len(a.unit) >= len(b.unit):
        for half in a.halves():
            ego_join(half, b, eps, cosine, found)
    else:
        for half in b.halves():
            ego_join(a, half, eps, cosine, found)


class Links:
    """Counts of each vector's links, weighted by copies, and a spanning forest instead of all pairs."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.count = weight, np.zeros(len(weight), np.int64)
        self.parent = np.arange(len(weight))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)

    def __call__(self, a: Interval, b: Interval, mask: np.ndarray | None, both: bool) -> None:
        """both: rows of a and of b gain links; else those of a only (an interval against itself)."""
        rows, cols = slice(a.first, a.first + len(a.unit)), slice(b.first, b.first + len(b.unit))
        if mask is None:
            self.count[rows] += self.weight[cols].sum()
            if both:
                self.count[cols] += self.weight[rows].sum()
            for y in range(cols.start, cols.stop):
                self.join(a.first, y)
            for x in range(rows.start, rows.stop):
                self.join(x, b.first)
            return
        self.count[rows] += mask @ self.weight[cols]
        if both:
            self.count[cols] += self.weight[rows] @ mask
        for x in np.flatnonzero(mask.any(axis=1)):
            hits = b.first + np.flatnonzero(mask[x])
            r = self.root(a.first + int(x))
            for y in hits[self.parent[hits] != r]:
                self.join(a.first + int(x), int(y))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, dimensions: int = GRID_DIMENSIONS, sequence_rows: int = SEQUENCE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (vec_id = component_id).

    Equal vectors are one class with a weight; classes are joined, so copies cost nothing more. Unit
    vectors are projected on the leading principal dimensions (fitted on all rows), and ordered by
    grid cells of side eps = sqrt(2 - 2 cosine). Intervals of that order form the join's tasks: two meet
    only if their boxes are within eps of each other. Link counts and a spanning forest leave a task, never
    all pairs. Null vectors, zero vectors and ones with null or non-finite components link with
    nothing, nor do vectors of different lengths with each other; they keep n_links 0 and their own id.
    Rows that share an id are vectors of their own; a null id never names a component. Empty tables
    give an empty result; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = stored(vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), (usable(vector_col) & F.exists(v, lambda x: x != 0)).alias("valid")))
    valid = rows.where("valid").withColumn("class", F.xxhash64("v")).select("vec_id", "class", "v")
    classes = stored(valid.groupBy("class", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight")).withColumn("class", F.xxhash64("v", F.lit(7))))
    counted, edges = _joined(classes, cosine, dimensions, sequence_rows)
    linked = components(edges)
    rooted = stored(classes.join(counted, "class", "left").join(linked, classes["class"] == linked.node, "left").select("class", "v", "first_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(named, "root").select("v", "n_links", "component_id")
    out = valid.select("vec_id", "v").join(of_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("valid is null or not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _joined(classes: DataFrame, cosine: float, dimensions: int, sequence_rows: int) -> tuple[DataFrame, DataFrame]:
    """(class, others: linked vectors of other classes) and edges (a, b) of a spanning forest."""
    spark, eps = classes.sparkSession, float(np.sqrt(2 - 2 * cosine))
    empty = spark.createDataFrame([], "class long, others long"), spark.createDataFrame([], "a long, b long")
    scaled = Normalizer(p=float("inf"), inputCol="x", outputCol="s").transform(classes.select("class", "weight", array_to_vector("v").alias("x"), F.size("v").alias("dim")))  # squares of huge components stay finite
    unit = stored(Normalizer(p=2.0, inputCol="s", outputCol="n").transform(scaled).select("class", "weight", vector_to_array("n").alias("u"), "dim"))
    dims = [r.dim for r in unit.select("dim").distinct().orderBy("dim").collect()]  # lengths of vectors, a handful
    ordered = None
    for dim in dims:
        some = unit.where(F.col("dim") == dim).withColumn("x", array_to_vector("u"))
        k = min(dimensions, dim)
        placed = PCA(k=k, inputCol="x", outputCol="p").fit(some).transform(some).withColumn("grid", vector_to_array("p")).select("class", "weight", "u", "dim", "grid")
        ordered = placed if ordered is None else ordered.unionByName(placed)
    if ordered is None:
        return empty
    n = unit.count()
    cells = [F.floor(F.get("grid", F.lit(k)) / eps) for k in range(dimensions)]
    # one range partition holds several sequence intervals; equal cells are told apart by their place and class
    in_order = ordered.repartitionByRange(max(1, n // (4 * sequence_rows) + 1), "dim", *cells, F.get("grid", F.lit(0)), "class").sortWithinPartitions("dim", *cells, F.get("grid", F.lit(0)), "class")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, dim = TaskContext.get().partitionId() << 24, 0, None
        for batch in batches:
            mine = []
            for d in batch.dim:
                if held == sequence_rows or (dim is not None and d != dim):
                    number, held = number + 1, 0
                held, dim = held + 1, d
                mine.append(number)
            batch["seq"] = mine
            yield batch

    cut_rows = stored(in_order.mapInPandas(cut, "class long, weight long, u array<double>, dim int, grid array<double>, seq long"))
    box = [f(F.get("grid", F.lit(k))).alias(f"{s}{k}") for k in range(dimensions) for f, s in ((F.min, "lo"), (F.max, "hi"))]
    small = stored(cut_rows.groupBy("seq", "dim").agg(F.count("*").alias("rows"), *box))
    # neighbouring short intervals become one, however many range partitions there were; one row per interval here
    before = Window.partitionBy("dim").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    merged = stored(small.withColumn("at", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / sequence_rows)).withColumn("whole", F.min("seq").over(Window.partitionBy("dim", "at"))))
    seqs = stored(cut_rows.join(merged.select("seq", "whole"), "seq").select("class", "weight", "u", "grid", F.col("whole").alias("seq")))
    discard(cut_rows)
    boxes = stored(merged.groupBy(F.col("whole").alias("seq"), "dim").agg(*(f(f"{s}{k}").alias(f"{s}{k}") for k in range(dimensions) for f, s in ((F.min, "lo"), (F.max, "hi")))))
    cell = lambda c: F.floor(F.col(c) / eps).cast("int")
    left = boxes.select(*(F.col(c).alias(f"l_{c}") for c in boxes.columns), F.explode(F.sequence(cell("lo0") - 1, cell("hi0") + 1)).alias("cell"))
    right = boxes.select(*(F.col(c).alias(f"r_{c}") for c in boxes.columns), F.explode(F.sequence(cell("lo0"), cell("hi0"))).alias("cell"))
    gaps = [F.greatest(F.col(f"l_lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"l_hi{k}"), F.lit(0.0)) for k in range(dimensions)]
    gap = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps[1:]), gaps[0] * gaps[0])
    near = left.join(right, (F.col("l_dim") == F.col("r_dim")) & (left.cell == right.cell) & (F.col("l_seq") <= F.col("r_seq")) & (F.sqrt(gap) <= eps + SLACK))
    pairs = near.select(F.col("l_seq").alias("s"), F.col("r_seq").alias("t")).distinct()
    sides = stored(pairs.select("s", "t", F.explode(F.array_distinct(F.array("s", "t"))).alias("seq")))
    met = sides.join(seqs.select("seq", "class", "weight", "u", "grid"), "seq")

    def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        s, t = key
        g = g.sort_values(["seq", "class"], kind="stable").reset_index(drop=True)
        unit_all, grid_all = np.stack(g.u), np.stack(g.grid)
        order = np.lexsort((grid_all[:, 0], *np.floor(grid_all / eps).T[::-1], g.seq.to_numpy()))
        unit_all, grid_all, g = unit_all[order], grid_all[order], g.iloc[order].reset_index(drop=True)
        links = Links(g.weight.to_numpy())
        m = int((g.seq == s).sum())
        a = Interval(unit_all[:m], grid_all[:m], 0)
        if s == t:
            ego_join(a, a, eps, cosine, lambda x, y, mask: links(x, y, mask, False))
            links.count -= links.weight  # a class with itself
        else:
            ego_join(a, Interval(unit_all[m:], grid_all[m:], m), eps, cosine, lambda x, y, mask: links(x, y, mask, True))
        roots = np.array([links.root(x) for x in range(len(g))])
        names = g["class"].to_numpy()
        some = np.flatnonzero((links.count > 0) | (roots != np.arange(len(g))))
        return pd.DataFrame({"class": names[some], "root": names[roots[some]], "others": links.count[some]})

    found = stored(met.groupBy("s", "t").applyInPandas(work, "class long, root long, others long"))
    return found.groupBy("class").agg(F.sum("others").alias("others")), found.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()


def op6_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs, and labels passed along links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
      WHERE a.r > 0 AND b.r > 0 AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.r * b.r) >= 0.95),
w AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, w.c FROM w JOIN l ON w.vec_id = l.a WHERE w.c < l.b),
m AS (SELECT vec_id, min(c) AS component_id FROM w GROUP BY vec_id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.vec_id = m.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
