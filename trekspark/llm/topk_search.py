"""Exact top-k search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekspark.llm.common import read_table, stored

PIVOTS = 32
PIVOT_SAMPLE = 4096  # vectors that pivots are picked from
QUERY_BLOCK = 4096  # queries that one task answers together; candidates are dealt once per block of queries
CANDIDATE_BLOCK = 8192
EVALUATED = 64  # candidates evaluated between two looks at the bound
SAFE = float(1 << 53)  # products below it are exact in double precision


def usable(vector: str) -> Column:
    """Whether a vector is there and holds finite components only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of ``count`` vectors of the sample: each is the one farthest from those before."""
    if not len(sample):
        return sample
    at = [int(np.argmax((sample**2).sum(axis=1)))]
    far = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(count, len(sample)) and far.max() > 0:
        at.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(id, v array<double>, norm, dim, distances array<float>): each vector with its distances to the
    pivots of its length. Pivots are picked from at most ``sample`` vectors, by a hash of the id."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    chosen = {dim: pick_pivots(np.stack(g.v.to_numpy()), pivots) for dim, g in some.groupby(some.v.map(len))} if len(some) else {}
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)  # pivots vectors of each sampled length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["dim"] = batch.v.map(len).astype(np.int32)
            batch["distances"] = None
            for dim, g in batch.groupby("dim"):
                p = shared.value.get(dim)
                v = np.stack(g.v.to_numpy()) if dim else np.zeros((len(g), 0))
                d = np.zeros((len(v), 0)) if p is None else np.sqrt(np.maximum(((v[:, None, :] - p[None]) ** 2).sum(axis=2), 0))
                batch.loc[g.index, "distances"] = pd.Series(list(d), index=g.index, dtype=object)
            yield batch

    return vectors.mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, v array<double>, dim int, distances array<double>")


def search_block(q_id: np.ndarray, q: np.ndarray, q_far: np.ndarray, c_id: np.ndarray, c: np.ndarray, c_far: np.ndarray, k: int) -> list[tuple]:
    """(query id, candidate id, score) of each query's k best inner products among the candidates,
    ties to the smaller id; a candidate with the query's id is left out.

    max over pivots of |d(q, p) - d(c, p)| is a lower bound of d(q, c), so
    (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of q . c. Candidates are evaluated in the order of
    that bound, until no bound left reaches the k-th best score: the stop is exact.
    """
    c_norm = (c**2).sum(axis=1)
    exact = np.sqrt((q**2).sum(axis=1).max(initial=0)) * np.sqrt(c_norm.max(initial=0)) < SAFE
    out = []
    for i in range(len(q)):
        low = np.abs(c_far - q_far[i]).max(axis=1) if c_far.shape[1] else np.zeros(len(c))
        norm = float((q[i] ** 2).sum())
        low = np.maximum(low - 1e-9 * (np.sqrt(norm) + np.sqrt(c_norm) + 1), 0)
        high = (norm + c_norm - low**2) / 2
        high += 1e-9 * (norm + c_norm) + 0.5
        high[c_id == q_id[i]] = -np.inf
        order = np.argsort(-high, kind="stable")
        best_s, best_id = np.zeros(0), np.zeros(0, c_id.dtype)
        step, first = EVALUATED, 0
        while first < len(order) and high[order[first]] > -np.inf:
            if len(best_s) == k and high[order[first]] < best_s[-1]:
                break
            at = order[first : first + step]
            at = at[high[at] > -np.inf]
            s = c[at] @ q[i] if exact else np.array([sum(int(x) * int(y) for x, y in zip(c[j], q[i])) for j in at], object)
            best_s, best_id = np.concatenate([best_s, s]), np.concatenate([best_id, c_id[at]])
            top = np.lexsort((best_id, -best_s))[:k] if exact else sorted(range(len(best_s)), key=lambda j: (-best_s[j], best_id[j]))[:k]
            best_s, best_id = best_s[top], best_id[top]
            first, step = first + step, step * 2
        out += [(q_id[i], y, max(min(int(s), (1 << 63) - 1), -(1 << 63))) for y, s in zip(best_id, best_s)]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` candidates of the highest inner product, exactly: query_id, rank (from 1), vec_id, score.

    Both tables hold whole-numbered vectors as array<double>. Query blocks meet candidate blocks; a
    task holds one of each. A candidate never answers a query of its own id. Vectors of different
    lengths are not compared. Null vectors, and ones with null or non-finite components, take no part,
    and so do null ids. Repeated rows count each. With fewer than k candidates all are given. Scores beyond long
    stop at its ends. Empty tables give an empty result; other columns are not read.
    """
    kind = dict(candidates.dtypes)[id_col]
    usable_rows = lambda df: df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    table = stored(pivot_table(usable_rows(candidates), pivots))
    asked = stored(pivot_table_like(usable_rows(queries), table, pivots))
    n_q, n_c = asked.count(), table.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))
    c = table.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(c_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for dim, a in left.groupby("dim"):
            b = right[right.dim == dim]
            if len(b):
                rows += search_block(a.id.to_numpy(), np.stack(a.v), np.stack(a.distances), b.id.to_numpy(), np.stack(b.v), np.stack(b.distances), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["qb", "cb", "dim"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pivot_table_like(queries: DataFrame, table: DataFrame, pivots: int) -> DataFrame:
    """The queries' rows of the pivot table, where they are candidates too; a table of their own pivots would not match."""
    return table.join(queries.select("id").distinct(), "id", "left_semi")


def op2_pivot_table_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).when(F.abs(x) >= float(1 << 43), x * 1024).otherwise(F.floor(x * 1024).cast("double")))  # from 2^43 on, 1024 x is whole
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("embedding"))
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


#: The same search as brute force.
OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * qe[i])) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.query_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
