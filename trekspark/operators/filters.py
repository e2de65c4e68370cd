"""Filters and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekspark.functions.geo import haversine_m
from trekspark.operators.expressions import HOPS_SQL, hop_metres, point_speed, track_order
from trekspark.plans.registry import query

# Classes of points of interest that are kept, and codes within them that are not.
KEPT_CLASSES = ["05", "06", "08", "10", "11", "14", "20"]
DROPPED_CODES = ["1412", "1413", "1414", "1415"]


def boundary_edges(ring: DataFrame) -> DataFrame:
    """Edges (scene, x1, y1, x2, y2) of each scene's ring of vertices (scene, i, lon, lat), closed."""
    w = Window.partitionBy("scene").orderBy("i")
    first = Window.partitionBy("scene").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ring.select("scene", "i", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.coalesce(F.lead("lon").over(w), F.first("lon").over(first)).alias("x2"), F.coalesce(F.lead("lat").over(w), F.first("lat").over(first)).alias("y2"))


def filter_polygon(points: DataFrame, ring: DataFrame) -> DataFrame:
    """Points inside their scene's ring: an odd number of edges, half-open in latitude, at or right of the point.

    A scene's edges travel as one array, so a point meets its scene once and no rows are multiplied.
    """
    edges = boundary_edges(ring).groupBy("scene").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    crossed = F.size(F.filter("_edges", lambda e: (F.least(e.y1, e.y2) < F.col("lat")) & (F.col("lat") <= F.greatest(e.y1, e.y2)) & (F.col("lon") <= F.greatest(e.x1, e.x2)) & ((e.x1 == e.x2) | (F.col("lon") <= (F.col("lat") - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) + e.x1))))
    return points.join(edges, "scene").where(crossed % 2 == 1).select(points["*"])


@query("filter_polygon", """WITH e AS (SELECT scene, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM fx_b WINDOW w AS (PARTITION BY scene ORDER BY i))
SELECT track_id, event_id FROM (SELECT p.track_id, p.event_id, count(*) AS n FROM fx_p p JOIN e ON e.scene = p.scene AND least(y1, y2) < lat AND lat <= greatest(y1, y2) AND lon <= greatest(x1, x2) AND (x1 = x2 OR lon <= (lat - y1) * (x2 - x1) / (y2 - y1) + x1) GROUP BY 1, 2) WHERE n % 2 = 1""")
def _(t):
    return filter_polygon(t.fx_p, t.fx_b).select("track_id", "event_id")


def filter_bbox(points: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    return points.where(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))


@query("filter_bbox", "SELECT track_id, event_id FROM fx_p WHERE lat BETWEEN 298e-1 AND 3010e-2 AND lon BETWEEN 1037999e-4 AND 1043e-1")
def _(t):
    return filter_bbox(t.fx_p, 298e-1, 3010e-2, 1037999e-4, 1043e-1).select("track_id", "event_id")


def drop_jump_tracks(points: DataFrame, max_jump_m: float = 100.0) -> DataFrame:
    """Drop a whole track if a pair of points with dt > 0 is more than ``max_jump_m`` apart."""
    dt = F.col("t_s") - F.lag("t_s").over(track_order())
    jump = F.coalesce((dt > 0) & (F.col("hop_m") > max_jump_m), F.lit(False))
    flagged = hop_metres(points).withColumn("_jump", jump)
    return flagged.withColumn("_any", F.max("_jump").over(Window.partitionBy("track_id"))).where("not _any").select(points.columns)


CLEAN_SQL = f"h AS ({HOPS_SQL}), good AS (SELECT * FROM fx_p WHERE track_id NOT IN (SELECT track_id FROM h WHERE dt_s > 0 AND hop_m > 100))"


@query("drop_jump_tracks", f"WITH {CLEAN_SQL} SELECT track_id, event_id FROM good")
def _(t):
    return drop_jump_tracks(t.fx_p).select("track_id", "event_id")


def drop_short_tracks(points: DataFrame, min_points: int = 300) -> DataFrame:
    """Tracks of at least ``min_points``, with new_id 0 .. N - 1 in the order of track_id: a place within
    each run of 4,096 ids, after the tracks of the runs before, so no task sorts all tracks."""
    long = points.groupBy("track_id").count().where(F.col("count") >= min_points).select("track_id")
    placed = long.withColumn("_run", F.floor(F.col("track_id") / 4096))
    runs = placed.groupBy("_run").agg(F.count("*").alias("_c"))
    runs = runs.select("_run", (F.sum("_c").over(Window.orderBy("_run")) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy("track_id")) - 1
    ids = placed.withColumn("_in", inside).join(runs, "_run").select("track_id", (F.col("_in") + F.col("_before")).cast("int").alias("new_id"))
    return points.join(ids, "track_id")


@query("drop_short_tracks", "WITH k AS (SELECT track_id, CAST(row_number() OVER (ORDER BY track_id) - 1 AS INT) AS new_id FROM fx_p GROUP BY track_id HAVING count(*) >= 60) SELECT track_id, event_id, new_id FROM fx_p JOIN k USING (track_id)")
def _(t):
    return drop_short_tracks(t.fx_p, 60).select("track_id", "event_id", "new_id")


def screen_tracks(points: DataFrame, box: tuple, min_points: int = 50, max_gap_s: float = 259200.0, min_km: float = 5.0) -> DataFrame:
    """(track_id, reason): the first rule that a track breaks, or ok: points, points in the box, gap, length."""
    lat_min, lat_max, lon_min, lon_max = box
    inside = F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max)
    counts = points.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in"))
    within = hop_metres(points.where(inside)).withColumn("dt", F.col("t_s") - F.lag("t_s").over(track_order()))
    sums = within.groupBy("track_id").agg(F.max("dt").alias("gap"), (F.sum("hop_m") / 1000).alias("km"))
    reason = F.when(F.col("n") < min_points, "few_points").when(F.col("n_in") < min_points, "few_in_box").when(F.col("gap") > max_gap_s, "gap").when(F.coalesce("km", F.lit(0.0)) < min_km, "short").otherwise("ok")
    return counts.join(sums, "track_id", "left").select("track_id", reason.alias("reason"))


@query("screen_tracks", f"""WITH i AS (SELECT * FROM fx_p WHERE lat BETWEEN 29 AND 3010e-2 AND lon BETWEEN 103 AND 1043e-1), h AS ({HOPS_SQL.replace('FROM fx_p', 'FROM i')}),
s AS (SELECT track_id, max(dt_s) AS gap, sum(hop_m) / 1000 AS km, count(*) AS n_in FROM h GROUP BY track_id), c AS (SELECT track_id, count(*) AS n FROM fx_p GROUP BY track_id),
r AS (SELECT CASE WHEN n < 60 THEN 'few_points' WHEN coalesce(n_in, 0) < 60 THEN 'few_in_box' WHEN gap > 500 THEN 'gap' WHEN coalesce(km, 0) < 1 THEN 'short' ELSE 'ok' END AS reason FROM c LEFT JOIN s USING (track_id))
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def _(t):
    return screen_tracks(t.fx_p, (29.0, 30.1, 103.0, 104.3), 60, 500.0, 1.0).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def filter_poi_types(poi: DataFrame) -> DataFrame:
    """kept: whether the code's class is kept and the code is not a school or research code."""
    code = F.col("type_code")
    dropped = F.substring(code, 1, 4).isin(DROPPED_CODES)
    return poi.withColumn("kept", F.substring(code, 1, 2).isin(KEPT_CLASSES) & ~dropped)


@query("filter_poi_types", "WITH k AS (SELECT type_code, substr(type_code, 1, 2) IN ('05','06','08','10','11','14','20') AND substr(type_code, 1, 4) NOT IN ('1412','1413','1414','1415') AS kept FROM fx_poi) SELECT type_code, kept, count(*) AS n FROM k GROUP BY 1, 2")
def _(t):
    return filter_poi_types(t.fx_poi).groupBy("type_code", "kept").agg(F.count("*").alias("n"))


def drop_vehicle_tracks(points: DataFrame, max_median_kmh: float = 15.0, min_points: int = 10) -> DataFrame:
    """Drop tracks under ``min_points``, and those whose median speed without the first point is too high."""
    moved = point_speed(points).withColumn("_n", F.row_number().over(track_order()))
    slow = moved.groupBy("track_id").agg(F.percentile(F.when(F.col("_n") > 1, F.col("speed")), 0.5).alias("m"), F.count("*").alias("n")).where((F.col("m") <= max_median_kmh) & (F.col("n") >= min_points))
    return points.join(slow.select("track_id"), "track_id", "left_semi")


@query("drop_vehicle_tracks", f"WITH h AS ({HOPS_SQL}), m AS (SELECT track_id FROM h GROUP BY track_id HAVING quantile_cont(CASE WHEN dt_s > 0 THEN hop_m / dt_s * 3.6e0 WHEN dt_s IS NOT NULL THEN 0e0 END, 0.5) <= 4 AND count(*) >= 10) SELECT track_id, event_id FROM fx_p WHERE track_id IN (SELECT track_id FROM m)")
def _(t):
    return drop_vehicle_tracks(t.fx_p, 4.0).select("track_id", "event_id")


@query("drop_bad_time_segments", "WITH d AS (SELECT track_id, event_id, t_s, CAST(floor((row_number() OVER o - 1) / 20) AS INT) AS seg FROM fx_p WINDOW o AS (PARTITION BY track_id ORDER BY t_s, event_id)), f AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY track_id, seg ORDER BY t_s, event_id) AS dt FROM d) SELECT track_id, seg, max(t_s) - min(t_s) AS dur FROM f GROUP BY 1, 2 HAVING max(dt) <= 300 AND min(dt) > 0 AND max(t_s) > min(t_s)")
def _(t):
    seg = F.floor((F.row_number().over(track_order()) - 1) / 20).cast("int")
    rows = t.fx_p.withColumn("seg", seg)
    return good_time_segments(rows, ["track_id", "seg"], 300.0).select("track_id", "seg", "dur")


def good_time_segments(points: DataFrame, keys: list[str], max_gap_s: float = 3600.0) -> DataFrame:
    """Segments (keys, dur) whose inner steps all advance by at most ``max_gap_s`` and that last a time."""
    w = Window.partitionBy(*keys).orderBy("t_s", "event_id")
    d = points.withColumn("_dt", F.col("t_s") - F.lag("t_s").over(w))
    a = d.groupBy(*keys).agg(F.max("_dt").alias("_hi"), F.min("_dt").alias("_lo"), (F.max("t_s") - F.min("t_s")).alias("dur"))
    return a.where((F.col("_hi") <= max_gap_s) & (F.col("_lo") > 0) & (F.col("dur") > 0))


@query("valid_records", "WITH s AS (SELECT track_id, region_id, min(t_s) AS t FROM fx_r GROUP BY 1, 2), d AS (SELECT track_id, t, lead(t) OVER (PARTITION BY track_id ORDER BY t, region_id) - t AS dur FROM s), a AS (SELECT track_id, count(*) AS n, max(dur) AS longest, sum(dur) AS total FROM d GROUP BY track_id) SELECT track_id, n, total FROM a WHERE n >= 2 AND longest <= 36e3 AND total > 0")
def _(t):
    return valid_records(t.fx_r, 36e3)


def valid_records(visits: DataFrame, max_step_s: float = 14400.0) -> DataFrame:
    """Tracks (track_id, n, total) of at least two regions, no step over ``max_step_s``, and a total time."""
    s = visits.groupBy("track_id", "region_id").agg(F.min("t_s").alias("t"))
    d = s.withColumn("dur", F.lead("t").over(Window.partitionBy("track_id").orderBy("t", "region_id")) - F.col("t"))
    return d.groupBy("track_id").agg(F.count("*").alias("n"), F.max("dur").alias("longest"), F.sum("dur").alias("total")).where((F.col("n") >= 2) & (F.col("longest") <= max_step_s) & (F.col("total") > 0)).select("track_id", "n", "total")


def dedup_near_tracks(points: DataFrame) -> DataFrame:
    """track_id of the longest track (then the largest id) of each start (3 decimals) and length (0.1 km)."""
    hops = hop_metres(points)
    per = hops.groupBy("track_id").agg(F.min_by("lat", F.struct("t_s", "event_id")).alias("lat"), F.min_by("lon", F.struct("t_s", "event_id")).alias("lon"), (F.coalesce(F.sum("hop_m"), F.lit(0.0)) / 1000).alias("km"))
    sig = [F.round("lat", 3), F.round("lon", 3), F.round("km", 1)]
    return per.withColumn("_k", F.row_number().over(Window.partitionBy(*sig).orderBy(F.round("km", 6).desc(), F.desc("track_id")))).where("_k = 1").select("track_id")


@query("dedup_near_tracks", f"WITH h AS ({HOPS_SQL}), a AS (SELECT track_id, arg_min(lat, (t_s, event_id)) AS lat, arg_min(lon, (t_s, event_id)) AS lon, coalesce(sum(hop_m), 0) / 1000 AS km FROM h GROUP BY track_id) SELECT track_id FROM (SELECT track_id, row_number() OVER (PARTITION BY round(lat, 3), round(lon, 3), round(km, 1) ORDER BY round(km, 6) DESC, track_id DESC) AS k FROM a) WHERE k = 1")
def _(t):
    return dedup_near_tracks(t.fx_p)


def dedup_poi(poi: DataFrame, key: str) -> DataFrame:
    """One row (the smallest poi_id) of each key; rows with an empty key all stay."""
    keyed = poi.where(F.coalesce(F.col(key), F.lit("")) != "")
    one = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("scene", key).orderBy("poi_id"))).where("_k = 1").drop("_k")
    return one.unionByName(poi.where(F.coalesce(F.col(key), F.lit("")) == ""))


@query("dedup_poi", "WITH k AS (SELECT scene, poi_id, CASE WHEN poi_id % 7 = 0 THEN '' ELSE type_code END AS code FROM fx_poi) SELECT scene, poi_id FROM (SELECT *, row_number() OVER (PARTITION BY scene, code ORDER BY poi_id) AS r FROM k) WHERE r = 1 OR code = ''")
def _(t):
    keyed = t.fx_poi.select("scene", "poi_id", F.when(F.col("poi_id") % 7 == 0, "").otherwise(F.col("type_code")).alias("code"))
    return dedup_poi(keyed, "code").select("scene", "poi_id")


def bbox_from_anchor(points: DataFrame, anchors: DataFrame, widths: list[float], least: float = 0.85) -> DataFrame:
    """(scene, half_width, coverage): the smallest width whose box around the anchor covers ``least`` of the
    points, else the largest. All widths are tested in one aggregation."""
    joined = points.join(anchors.select("scene", F.col("lon").alias("_x"), F.col("lat").alias("_y")), "scene")
    far = F.greatest(F.abs(F.col("lon") - F.col("_x")), F.abs(F.col("lat") - F.col("_y")))
    share = joined.groupBy("scene").agg(*(F.avg(F.when(far <= w, 1.0).otherwise(0.0)).alias(f"_{k}") for k, w in enumerate(widths)))
    pick = F.coalesce(*(F.when(F.col(f"_{k}") >= least, F.struct(F.lit(w).alias("w"), F.col(f"_{k}").alias("c"))) for k, w in enumerate(widths)), F.struct(F.lit(widths[-1]).alias("w"), F.col(f"_{len(widths) - 1}").alias("c")))
    return share.select("scene", pick.w.alias("half_width"), pick.c.alias("coverage"))


@query("bbox_from_anchor", "WITH a AS (SELECT scene, 103.3e0 + 5e-1 * scene AS x, 29.5e0 + 3e-1 * scene AS y FROM (SELECT DISTINCT scene FROM fx_p)), w AS (SELECT unnest([1e-3, 2e-3, 3e-3, 4e-3]) AS w), c AS (SELECT p.scene, w, avg(CASE WHEN greatest(abs(lon - x), abs(lat - y)) <= w THEN 1e0 ELSE 0e0 END) AS c FROM fx_p p JOIN a ON a.scene = p.scene CROSS JOIN w GROUP BY 1, 2) SELECT scene, coalesce(min(CASE WHEN c >= 6e-1 THEN w END), 4e-3) AS half_width, round(coalesce(arg_min(c, w) FILTER (WHERE c >= 6e-1), max(c)), 6) AS coverage FROM c GROUP BY scene")
def _(t):
    anchors = t.fx_p.select("scene").distinct().select("scene", (F.lit(103.3) + F.col("scene") * 0.5).alias("lon"), (F.lit(29.5) + F.col("scene") * 0.3).alias("lat"))
    return bbox_from_anchor(t.fx_p, anchors, [1e-3, 2e-3, 3e-3, 4e-3], 0.6).withColumn("coverage", F.round("coverage", 6))


def bbox_from_density(points: DataFrame, cell: float = 0.02, least: float = 0.1) -> DataFrame:
    """(scene, cells, x_min, x_max, y_min, y_max) in cell numbers of the cells with at least ``least`` of the peak count."""
    n = points.groupBy("scene", F.floor(F.col("lon") / cell).alias("x"), F.floor(F.col("lat") / cell).alias("y")).count()
    peak = n.withColumn("_peak", F.max("count").over(Window.partitionBy("scene"))).where(F.col("count") >= F.col("_peak") * least)
    return peak.groupBy("scene").agg(F.count("*").alias("cells"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query("bbox_from_density", "WITH n AS (SELECT scene, CAST(floor(lon / 7e-4) AS BIGINT) AS x, CAST(floor(lat / 7e-4) AS BIGINT) AS y, count(*) AS n FROM fx_p GROUP BY 1, 2, 3), k AS (SELECT *, max(n) OVER (PARTITION BY scene) AS peak FROM n) SELECT scene, count(*) AS cells, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM k WHERE n >= peak * 1e-1 GROUP BY scene")
def _(t):
    return bbox_from_density(t.fx_p, 7e-4)


@query("drop_noise_rows", "WITH k AS (SELECT track_id, event_id, CASE WHEN region_id % 4 = 0 THEN -1 ELSE region_id END AS region_id FROM fx_r) SELECT track_id, event_id, CAST(dense_rank() OVER (ORDER BY region_id) - 1 AS INT) AS label FROM k WHERE region_id >= 0")
def _(t):
    noisy = t.fx_r.select("track_id", "event_id", F.when(F.col("region_id") % 4 == 0, -1).otherwise(F.col("region_id")).alias("region_id"))
    return drop_noise_rows(noisy).select("track_id", "event_id", "label")


def drop_noise_rows(df: DataFrame, label: str = "region_id") -> DataFrame:
    """Rows whose label is not -1, with label 0 .. N - 1; numbers come from one row per label."""
    kept = df.where(F.col(label) >= 0)
    ids = kept.select(label).distinct().withColumn("label", F.row_number().over(Window.orderBy(label)) - 1)
    return kept.join(ids, label)


def sample_cap(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows in the order of md5(seed | key); a top-k, so no full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


@query("sample_cap", "SELECT event_id FROM (SELECT event_id FROM fx_p ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 500)")
def _(t):
    return sample_cap(t.fx_p.select("event_id"), "event_id", 500)
