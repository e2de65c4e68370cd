"""Region, route and result reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekspark.operators.expressions import route_type, share_map
from trekspark.operators.trajectory import NEAREST_SQL, compress_sequence, nearest_centroid, sequences
from trekspark.plans.registry import query


@query("poi_profile", "WITH n AS (SELECT scene, substr(type_code, 1, 2) AS cls, count(*) AS n FROM fx_poi GROUP BY 1, 2) SELECT scene, cls, round(n / sum(n) OVER (PARTITION BY scene), 4) AS share FROM n")
def _(t):
    return share_map(t.fx_poi, ["scene"]).select("scene", F.explode("profile").alias("cls", "share"))


def poi_crosstab(poi: DataFrame, classes: list[str]) -> DataFrame:
    """Counts by scene and class, the total and the dominant class (ties to the smaller code)."""
    n = poi.groupBy("scene", F.substring("type_code", 1, 2).alias("cls")).agg(F.count("*").alias("n"))
    counts = n.groupBy("scene").pivot("cls", classes).agg(F.sum("n")).fillna(0, subset=classes)
    top = n.groupBy("scene").agg(F.sum("n").alias("total"), F.min_by("cls", F.struct(-F.col("n"), "cls")).alias("dominant"))
    return counts.join(top, "scene").select("scene", *(F.col(c).alias(f"c{c}") for c in classes), "total", "dominant")


@query("poi_crosstab", "WITH n AS (SELECT scene, substr(type_code, 1, 2) AS cls, count(*) AS n FROM fx_poi GROUP BY 1, 2) SELECT scene, CAST(sum(CASE WHEN cls = '05' THEN n ELSE 0 END) AS BIGINT) AS c05, CAST(sum(CASE WHEN cls = '11' THEN n ELSE 0 END) AS BIGINT) AS c11, CAST(sum(n) AS BIGINT) AS total, arg_min(cls, (-n, cls)) AS dominant FROM n GROUP BY scene")
def _(t):
    return poi_crosstab(t.fx_poi, ["05", "11"])


def region_meta(points: DataFrame) -> DataFrame:
    """Per region: distinct stop tracks, and the median gap under an hour between its sorted stop times."""
    stops = points.where("is_stop = 1").withColumn("gap", F.col("t_s") - F.lag("t_s").over(Window.partitionBy("region_id").orderBy("t_s", "track_id", "event_id")))
    return stops.groupBy("region_id").agg(F.countDistinct("track_id").alias("n_track"), F.count("*").alias("n_stop"), F.percentile(F.when(F.col("gap") < 3600, F.col("gap")), 0.5).alias("gap"))


@query("region_meta", "WITH s AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY region_id ORDER BY t_s, track_id, event_id) AS gap FROM fx_r WHERE is_stop = 1) SELECT region_id, count(DISTINCT track_id) AS n_track, count(*) AS n_stop, median(CASE WHEN gap < 3600 THEN gap END) AS gap FROM s GROUP BY region_id")
def _(t):
    return region_meta(t.fx_r)


@query("confusion_matrix", "WITH n AS (SELECT true_next, pred_next, count(*) AS n FROM fx_pred GROUP BY 1, 2) SELECT true_next, pred_next, n, round(n / sum(n) OVER (PARTITION BY true_next), 6) AS share FROM n")
def _(t):
    n = t.fx_pred.groupBy("true_next", "pred_next").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true_next")), 6))


@query("route_size_top", "WITH c AS (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM fx_r), s AS (SELECT route_id, track_id, count(*) AS n FROM c WHERE b IS NULL OR b <> region_id GROUP BY 1, 2) SELECT route_id, count(*) AS tracks, round(avg(n), 4) AS mean_len FROM s GROUP BY route_id ORDER BY tracks DESC, route_id LIMIT 3")
def _(t):
    s = compress_sequence(t.fx_r).groupBy("route_id", "track_id").agg(F.count("*").alias("n"))
    return s.groupBy("route_id").agg(F.count("*").alias("tracks"), F.round(F.avg("n"), 4).alias("mean_len")).orderBy(F.desc("tracks"), "route_id").limit(3)


@query("condition_table", "WITH s AS (SELECT target, grp, avg(mae_min) AS m FROM fx_res GROUP BY 1, 2), g AS (SELECT grp, avg(m) AS m FROM s GROUP BY grp) SELECT round(max(CASE WHEN grp = 'full' THEN m END), 5) AS full_mae, round(max(CASE WHEN grp = 'no_slope' THEN m END), 5) AS no_slope_mae FROM g")
def _(t):
    s = t.fx_res.groupBy("target", "grp").agg(F.avg("mae_min").alias("m"))
    mean = lambda g: F.round(F.avg(F.when(F.col("grp") == g, F.col("m"))), 5)
    return s.agg(mean("full").alias("full_mae"), mean("no_slope").alias("no_slope_mae"))


@query("unique_pairs", "SELECT DISTINCT scene, region_id FROM fx_r")
def _(t):
    return t.fx_r.select("scene", "region_id").dropDuplicates()


@query("join_track_meta", "SELECT f.track_id, f.event_id, c.c_mktsegment AS author FROM fx_p f LEFT JOIN customer c ON c.c_custkey = f.track_id")
def _(t):
    return t.fx_p.join(t.customer.select(F.col("c_custkey").alias("track_id"), F.col("c_mktsegment").alias("author")), "track_id", "left").select("track_id", "event_id", "author")


@query("retention", "WITH s AS (SELECT target, avg(CASE WHEN grp = 'full' THEN mae_min END) AS a, avg(CASE WHEN grp = 'no_slope' THEN mae_min END) AS b FROM fx_res GROUP BY target) SELECT target, round(a / b, 5) AS ratio, round(a - b, 5) AS gap FROM s")
def _(t):
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("mae_min")))
    s = t.fx_res.groupBy("target").agg(mean("full").alias("a"), mean("no_slope").alias("b"))
    return s.select("target", F.round(F.col("a") / F.col("b"), 5).alias("ratio"), F.round(F.col("a") - F.col("b"), 5).alias("gap"))


def named_routes(visits: DataFrame) -> DataFrame:
    """(track_id, kind, name): the route type of each track's region sequence, and its first ten regions
    where they take fewer than 80 characters, else the type alone."""
    ends = visits.groupBy("track_id").agg(F.min_by("lat", F.struct("t_s", "event_id")).alias("_a"), F.max_by("lat", F.struct("t_s", "event_id")).alias("_z"))
    kinds = sequences(visits).join(ends, "track_id").withColumn("kind", route_type("seq", "_a", "_z"))
    regions = F.array_join(F.transform(F.slice("seq", 1, 10), lambda x: x.cast("string")), "-")
    return kinds.select("track_id", "kind", F.when(F.length(regions) < 80, F.concat_ws(":", "kind", regions)).otherwise(F.col("kind")).alias("name"))


@query("route_type", f"WITH {NEAREST_SQL.format(src='fx_p')}, c AS (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM nc), q AS (SELECT track_id, list(region_id ORDER BY t_s, event_id) AS seq FROM c WHERE b IS NULL OR b <> region_id GROUP BY track_id), e AS (SELECT track_id, arg_min(lat, (t_s, event_id)) AS a, arg_max(lat, (t_s, event_id)) AS z FROM nc GROUP BY track_id), k AS (SELECT track_id, CASE WHEN len(seq) <= 2 THEN 'short' WHEN seq[1] = seq[-1] THEN 'loop' WHEN z > a THEN 'north' ELSE 'south' END AS kind, array_to_string(seq[1:10], '-') AS r FROM q JOIN e USING (track_id)) SELECT track_id, kind, CASE WHEN length(r) < 80 THEN kind || ':' || r ELSE kind END AS name FROM k")
def _(t):
    return named_routes(nearest_centroid(t.fx_p, t.fx_c))


def dem_tiles(points: DataFrame, keys: list[str]) -> DataFrame:
    """The one-degree tiles (lat0, lon0: south-west corners) that the bounding boxes of the groups of ``keys`` cover, once each."""
    low, high = (lambda c: F.floor(F.min(c))), (lambda c: F.floor(F.max(c)))
    box = points.groupBy(*keys).agg(F.sequence(low("lat"), high("lat")).alias("_a"), F.sequence(low("lon"), high("lon")).alias("_o"))
    return box.select(F.explode("_a").alias("lat0"), "_o").select("lat0", F.explode("_o").alias("lon0")).distinct()


@query("dem_tiles_for_bbox", "WITH b AS (SELECT track_id, CAST(floor(min(lat)) AS BIGINT) AS a1, CAST(floor(max(lat)) AS BIGINT) AS a2, CAST(floor(min(lon)) AS BIGINT) AS o1, CAST(floor(max(lon)) AS BIGINT) AS o2 FROM fx_p GROUP BY track_id), l AS (SELECT unnest(range(a1, a2 + 1)) AS lat0, o1, o2 FROM b) SELECT DISTINCT lat0, lon0 FROM (SELECT lat0, unnest(range(o1, o2 + 1)) AS lon0 FROM l)")
def _(t):
    return dem_tiles(t.fx_p, ["track_id"])
