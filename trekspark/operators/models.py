"""Forests and k-means clusters on track tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trekspark.graph import dealt, stored
from trekspark.operators.trajectory import nearest_centroid
from trekspark.plans.registry import query


def forest_duration(train: DataFrame, test: DataFrame, features: list[str], label: str = "dur_s", trees: int = 200, depth: int = 6, seed: int = 0) -> DataFrame:
    """``test`` with pred: the mean of ``trees`` regression trees, each on a sample of train rows. Train rows with a null
    feature or label are left out; test rows with a null feature have a null pred."""
    gather = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    forest = RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed)
    known = train.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label]))
    model = forest.fit(gather.transform(dealt(stored(known))))
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in features)
    unknown = test.where(f"NOT ({there})").withColumn("pred", F.lit(None).cast("double"))
    return model.transform(gather.transform(test.where(there))).drop("_x").unionByName(unknown)


@query("forest_duration")
def _(t):
    out = forest_duration(t.fx_s.where("track % 10 < 7"), t.fx_s.where("track % 10 >= 7"), ["dist_m", "up_m", "down_m", "elev_mean", "tod_hour"])
    return out.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("dur_s"))), 2).alias("mae"))


def kmeans(df: DataFrame, features: list[str], k: int | tuple = 3, seed: int = 0, starts: int = 10, scale: bool = True) -> DataFrame:
    """``df`` with cluster (from 0, in the order of the first feature of the centres): k-means on features of zero mean and unit deviation
    (as they are without ``scale``), the best of ``starts`` fits by squared distances. Of several ``k`` the one of the largest silhouette, ties to
    the smaller. Rows with a null feature have a null cluster."""
    gather = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in features)
    df = stored(df)  # read by all fits, each round and the result
    rows = gather.transform(df.where(there))
    scaled = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(rows).transform(rows) if scale else rows.withColumn("_x", F.col("_v"))
    each = [k] if isinstance(k, int) else sorted(k)
    fits = [[KMeans(featuresCol="_x", predictionCol="_c", k=n, seed=seed + i).fit(scaled) for i in range(starts)] for n in each]
    models = [min(of, key=lambda m: m.summary.trainingCost) for of in fits]
    scores = [ClusteringEvaluator(featuresCol="_x", predictionCol="_c").evaluate(m.transform(scaled)) if len(m.clusterCenters()) > 1 else -1.0 for m in models] if len(each) > 1 else [0.0]
    model = models[scores.index(max(scores))]
    centres = [tuple(c) for c in model.clusterCenters()]
    number = F.create_map(*(F.lit(x) for c, i in enumerate(sorted(range(len(centres)), key=centres.__getitem__)) for x in (i, c)))
    known = model.transform(scaled).withColumn("cluster", number[F.col("_c")]).drop("_v", "_x", "_c")
    return known.unionByName(df.where(f"NOT ({there})").withColumn("cluster", F.lit(None).cast("int")))


def best_groups(x: np.ndarray, k: int, starts: int = 10, seed: int = 0, rounds: int = 300) -> np.ndarray:
    """k-means labels of few rows, in the order of the centres: the best of ``starts`` fits by squared distances, each from rows drawn by their squared
    distance to those drawn before."""
    r, best = np.random.default_rng(seed), (np.inf, None, None)
    for _ in range(starts):
        centres = x[[r.integers(len(x))]]
        while len(centres) < k:
            gap = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, x[r.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else r.integers(len(x))]])
        labels = None
        for _ in range(rounds):
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            if labels is not None and (d.argmin(axis=1) == labels).all():
                break
            labels = d.argmin(axis=1)
            centres = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
        cost = ((x - centres[labels]) ** 2).sum()
        if cost < best[0]:
            best = (cost, labels, centres)
    _, labels, centres = best
    rank = np.empty(k, np.int64)
    rank[np.lexsort(centres.T[::-1])] = np.arange(k)
    return rank[labels]


def region_places(points: DataFrame) -> DataFrame:
    """(scene, region_id, lat, lon, ele, stay_s): mean place and elevation of each region's points (scene, region_id, lon, lat, ele, t_s, stop), and the
    median gap under an hour between its sorted stop times (0 without one). Times that many stops share are counted before they are sorted."""
    keys = ["scene", "region_id"]
    times = points.where("stop").groupBy(*keys, "t_s").agg(F.count("*").alias("_n"))
    gap = F.col("t_s") - F.lag("t_s").over(Window.partitionBy(*keys).orderBy("t_s"))
    gaps = times.withColumn("_gap", gap).select(*keys, F.explode(F.array(F.struct(F.col("_gap").alias("gap"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(0.0).alias("gap"), (F.col("_n") - 1).alias("n")))).alias("g")).select(*keys, "g.*").where("gap < 3600 AND n > 0")
    stay = gaps.groupBy(*keys).agg(F.percentile("gap", 0.5, F.col("n")).alias("stay_s"))
    places = points.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("lat", "lon", "ele")))
    return places.join(stay, keys, "left").withColumn("stay_s", F.coalesce("stay_s", F.lit(0.0)))


def region_roles(places: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """``places`` with cluster: the role of each region in its scene, by k-means on elevation and stay time of zero mean and unit deviation; a scene of
    fewer than three regions has a role each. Regions are few, so a scene's are one task's; one without an elevation has a null role."""
    schema = StructType([*places.schema.fields, StructField("cluster", IntegerType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("region_id")
        x = group[["ele", "stay_s"]].to_numpy(float)
        there, role = np.isfinite(x).all(axis=1), np.full(len(x), None)
        x = (x[there] - x[there].mean(axis=0)) / (x[there].std(axis=0) + 1e-6) if there.any() else x[there]
        role[there] = best_groups(x, min(k, len(x)), seed=seed) if len(x) >= 3 else np.arange(len(x))
        return group.assign(cluster=pd.array(role, "Int32"))

    return places.groupBy("scene").applyInPandas(run, schema)


def shared_prototypes(places: DataFrame, most: int = 64, seed: int = 0) -> DataFrame:
    """``places`` with prototype: the nearest of at most ``most`` shared places, fitted by k-means over the regions of all scenes by latitude, longitude and elevation."""
    places = stored(places)
    keys, features = ["scene", "region_id"], ["lat", "lon", "ele"]
    known = places.where("lat IS NOT NULL AND lon IS NOT NULL AND ele IS NOT NULL").count()
    near = kmeans(places.select(*keys, *features), features, min(most, known), seed, scale=False) if known > 1 else places.withColumn("cluster", F.when(F.expr("lat IS NOT NULL AND lon IS NOT NULL AND ele IS NOT NULL"), 0))
    return places.join(near.select(*keys, F.col("cluster").alias("prototype")), keys)


@query("kmeans")
def _(t):
    points = nearest_centroid(t.fx_p, t.fx_c).withColumn("stop", F.col("speed_kmh") <= 5)
    return shared_prototypes(region_roles(region_places(points))).select("scene", "region_id", "cluster", "prototype")
