"""Queries of the file readers and writers: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekspark.graph import shared_folder
from trekspark.operators.expressions import HOPS_SQL, hop_metres
from trekspark.operators.filters import drop_jump_tracks, filter_polygon
from trekspark.plans.registry import query
from trekspark.sources import files


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("read_track_csv", "SELECT track_id, event_id, t_s, lon, lat, ele, speed_kmh FROM fx_p")
def _(t):
    path = _folder(t)
    t.fx_p.drop("scene", "glitch").write.option("header", True).csv(path)
    out = files.read_track_csv(t.spark, path)
    return out.select(F.col("track_id").cast("long").alias("track_id"), F.col("event_id").cast("long").alias("event_id"), "t_s", "lon", "lat", "ele", "speed_kmh")


@query("read_gpx", "SELECT CAST(track_id AS VARCHAR) AS track, lat, lon, ele, CAST(t_s * 1000 AS BIGINT) AS epoch_ms FROM fx_p WHERE event_id % 7 > 0")
def _(t):
    path = _folder(t)
    time = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("<time>"), F.date_format(F.timestamp_seconds("t_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>"))).otherwise("")
    text = [f.cast("string") if not isinstance(f, str) else F.lit(f) for f in ('<trkpt lat="', F.col("lat"), '" lon="', F.col("lon"), '"><ele>', F.col("ele"), "</ele>")]
    point = F.concat(*text, time, F.lit("</trkpt>"))
    tracks = t.fx_p.groupBy("track_id").agg(F.array_join(F.collect_list(point), "").alias("p"))
    tracks.select(F.concat(F.lit("<gpx><trk><name>"), F.col("track_id").cast("string"), F.lit("</name><trkseg>"), "p", F.lit("</trkseg></trk></gpx>"))).write.text(path)
    return files.read_gpx(t.spark, path, document_per_line=True)


@query("read_boundary", "SELECT CASE WHEN scene = 3 THEN 'x' ELSE 'scene ' || CAST(scene AS VARCHAR) END AS name, i, lon, lat FROM fx_b UNION ALL SELECT 'scene 2', 6, lon, lat FROM fx_b WHERE scene = 2 AND i = 0")
def _(t):
    path = _folder(t)
    ring = F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda p: F.array(p.lon, p.lat))
    b = t.fx_b.groupBy("scene").agg(ring.alias("r")).withColumn("j", F.to_json("r"))
    kind = F.when(F.col("scene") == 0, "Polygon").when(F.col("scene") == 1, "MultiPolygon").otherwise("LineString")
    deep = F.when(F.col("scene") == 0, F.concat(F.lit("["), "j", F.lit("]"))).when(F.col("scene") == 1, F.concat(F.lit("[["), "j", F.lit("]]"))).otherwise(F.col("j"))
    doc = F.format_string('{"features":[{"properties":{"name":"scene %s"},"geometry":{"type":"%s","coordinates":%s}}]}', F.col("scene").cast("string"), kind, deep)
    plain = F.array_join(F.transform("r", lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))), ";")
    b.select(F.when(F.col("scene") == 3, plain).otherwise(doc)).write.text(path)
    out = files.read_boundary(t.spark, path)
    return out.withColumn("name", F.when(F.col("name").startswith("scene "), F.col("name")).otherwise("x"))


@query("read_poi", "SELECT scene, poi_id, name, type_code, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN poi_id % 3 = 0 THEN 'province' ELSE 'city' END AS city, '{\"rating\":\"' || CAST(poi_id % 5 AS VARCHAR) || '\"}' AS biz_ext FROM fx_poi")
def _(t):
    path = _folder(t)
    p = t.fx_poi
    city = F.when(F.col("poi_id") % 3 > 0, "city").otherwise(" ")
    place = F.format_string("%.6f,%.6f", "lon", "lat")
    p.select("scene", F.col("poi_id").alias("id"), "name", F.col("type_code").alias("typecode"), place.alias("location"), F.lit("province").alias("pname"), city.alias("cityname"), F.create_map(F.lit("rating"), (F.col("poi_id") % 5).cast("string")).alias("biz_ext")).write.json(path)
    return files.read_poi(t.spark, path).select("scene", "poi_id", "name", "type_code", "lon", "lat", "city", "biz_ext")


@query("read_segments", "SELECT scene, track, seg_idx, dist_m, up_m, dur_s FROM fx_s WHERE scene < 15")
def _(t):
    path = _folder(t)
    t.fx_s.select("scene", "track", "seg_idx", "dist_m", "up_m", "dur_s").repartition("scene").write.partitionBy("scene").option("header", True).csv(path)
    return files.read_segments(t.spark, path, [*range(15), 77], "track long, seg_idx int, dist_m double, up_m double, dur_s double")[0]


@query("read_clustered", "SELECT track_id, event_id, t_s, lon, lat, ele, speed_kmh, scene FROM fx_p")
def _(t):
    path = _folder(t)
    t.fx_p.select("scene", "track_id", "event_id", "t_s", "lon", "lat", "ele", "speed_kmh").write.partitionBy("scene").csv(path)
    return files.read_clustered(t.spark, path, "track_id long, event_id long, t_s double, lon double, lat double, ele double, speed_kmh double")


@query("scene_from_path", "SELECT s_suppkey, s_name AS scene FROM supplier")
def _(t):
    path = F.concat(F.lit("/data/x_cleaned/"), "s_name", F.element_at(F.array(F.lit(""), F.lit("_cleaned"), F.lit("_clustered")), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit(".csv"))
    return t.supplier.withColumn("path", path).select("s_suppkey", files.scene_of("path").alias("scene"))


@query("match_scene_file", "SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN '/d/' || s_name || '.csv' WHEN 1 THEN '/d/' || s_name || '_cleaned.csv' END AS file FROM supplier")
def _(t):
    exact = t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("/d/"), "s_name", F.lit(".csv")).alias("file"))
    suffixed = t.supplier.where("s_suppkey % 3 < 2").select(F.concat(F.lit("/d/"), "s_name", F.lit("_cleaned.csv")).alias("file"))
    return files.match_scene_file(t.supplier.select(F.col("s_name").alias("name")), exact.unionByName(suffixed))


@query("tidy_results", "SELECT target AS scene, seed, grp AS condition, mae_min AS value FROM fx_res")
def _(t):
    path = _folder(t)
    row = F.struct("target", "seed", "grp", "setting", "model", "mae_min")
    other = F.struct("target", "seed", "grp", F.lit("other").alias("setting"), "model", "mae_min")
    g = t.fx_res.groupBy("target").agg(F.collect_list(row).alias("a"), F.collect_list(other).alias("b")).select("target", F.concat("a", "b").alias("rows"))
    doc = F.when(F.col("target") % 3 == 0, F.to_json(F.struct("rows"))).when(F.col("target") % 3 == 1, F.to_json("rows")).otherwise(F.to_json(F.create_map(F.lit("seed0"), F.col("rows"))))
    g.select(doc).write.text(path)
    return files.tidy_results(t.spark, path, "zero-shot")


@query("write_cleaned", f"WITH h AS ({HOPS_SQL}) SELECT scene, count(*) AS n, count(hop_m) AS n_hops, max(lon) AS lon, count(CASE WHEN speed_kmh <= 1 THEN 1 END) AS slow FROM h GROUP BY scene")
def _(t):
    path = _folder(t)
    files.write_cleaned(hop_metres(t.fx_p), path)
    back = t.spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert set(back.columns) == set(files.CLEANED)
    return back.groupBy(F.col("scene").cast("int").alias("scene")).agg(F.count("*").alias("n"), F.count("hop_m").alias("n_hops"), F.max("lon").alias("lon"), F.count_if(F.col("speed_kmh") <= 1).alias("slow"))


@query("tracks_to_geojson", "SELECT track_id, count(*) AS n, round(avg(ele), 4) AS mean_ele, round(avg(speed_kmh), 4) AS mean_kmh, round(avg(CASE WHEN speed_kmh <= 1 THEN 1e0 ELSE 0e0 END), 4) AS stop_ratio, count(*) AS n_coordinates FROM fx_p GROUP BY track_id HAVING count(*) >= 2")
def _(t):
    g = files.tracks_to_geojson(t.fx_p)
    n = F.size(F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>")).cast("long")
    return g.select("track_id", "n", *(F.round(c, 4).alias(c) for c in ("mean_ele", "mean_kmh", "stop_ratio")), n.alias("n_coordinates"))


@query("write_results", "SELECT target, seed, count(*) AS n, round(sum(mae_min), 4) AS mae FROM fx_res GROUP BY 1, 2")
def _(t):
    path = _folder(t)
    files.write_results(t.fx_res.where("seed < 2"), path)
    files.write_results(t.fx_res, path, t.spark.read.parquet(path))
    return t.spark.read.parquet(path).groupBy("target", "seed").agg(F.count("*").alias("n"), F.round(F.sum("mae_min"), 4).alias("mae"))


@query("sort_track_time", "SELECT track_id, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS INT) AS k FROM fx_p")
def _(t):
    return files.numbered(t.fx_p).select("track_id", "event_id", "k")


@query("stage_funnel", f"""WITH e AS (SELECT scene, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM fx_b WINDOW w AS (PARTITION BY scene ORDER BY i)),
ins AS (SELECT p.track_id, p.event_id FROM fx_p p JOIN e ON e.scene = p.scene AND least(y1, y2) < lat AND lat <= greatest(y1, y2) AND lon <= greatest(x1, x2) AND (x1 = x2 OR lon <= (lat - y1) * (x2 - x1) / (y2 - y1) + x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1),
pin AS (SELECT * FROM fx_p WHERE (track_id, event_id) IN (SELECT track_id, event_id FROM ins)),
h AS ({HOPS_SQL.replace('FROM fx_p', 'FROM pin')}), good AS (SELECT * FROM pin WHERE track_id NOT IN (SELECT track_id FROM h WHERE dt_s > 0 AND hop_m > 100)),
long AS (SELECT * FROM good WHERE track_id IN (SELECT track_id FROM good GROUP BY 1 HAVING count(*) >= 20)),
n AS (SELECT 0 AS stage, 'raw' AS name, count(*) AS n FROM fx_p UNION ALL SELECT 1, 'polygon', count(*) FROM pin UNION ALL SELECT 2, 'jumps', count(*) FROM good UNION ALL SELECT 3, 'short', count(*) FROM long)
SELECT name, n, round(1e2 * n / nullif(lag(n) OVER (ORDER BY stage), 0), 4) AS kept FROM n""")
def _(t):
    inside = filter_polygon(t.fx_p, t.fx_b)
    good = drop_jump_tracks(inside)
    long = good.join(good.groupBy("track_id").count().where("count >= 20").select("track_id"), "track_id", "left_semi")
    return stage_funnel([("raw", t.fx_p), ("polygon", inside), ("jumps", good), ("short", long)])


def stage_funnel(stages: list) -> DataFrame:
    """(name, n, kept): rows after each (name, table) and the percent of the stage before that is left."""
    counts = files.first_of([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("stage"), F.lit(name).alias("name"), "n") for k, (name, df) in enumerate(stages)])
    before = F.lag("n").over(files.Window.orderBy("stage"))  # one row per stage
    return counts.select("name", "n", F.round(100.0 * F.col("n") / F.nullif(before, F.lit(0)), 4).alias("kept"))


def quality_report(points: DataFrame, bins: int = 50) -> DataFrame:
    """(metric, bin, n): ``bins`` bins of speeds up to 20 km/h, of elevations between their extremes, and of tracks' points."""
    value = lambda metric, c: points.select(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("v"))
    lengths = points.groupBy("track_id").agg(F.count("*").cast("double").alias("v")).select(F.lit("points").alias("metric"), "v")
    every = value("speed", "speed_kmh").where("v <= 20").unionByName(value("elevation", "ele")).unionByName(lengths).where("v is not null")
    ends = every.groupBy("metric").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(0)
    return every.join(ends, "metric").groupBy("metric", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("quality_report", """WITH v AS (SELECT 'speed' AS metric, speed_kmh AS v FROM fx_p WHERE speed_kmh <= 20 UNION ALL SELECT 'elevation', CAST(ele AS DOUBLE) FROM fx_p UNION ALL SELECT 'points', CAST(count(*) AS DOUBLE) FROM fx_p GROUP BY track_id),
e AS (SELECT metric, min(v) AS low, max(v) AS high FROM v GROUP BY 1)
SELECT metric, CAST(CASE WHEN high > low THEN least(floor((v - low) * 50 / (high - low)), 49) ELSE 0 END AS INT) AS bin, count(*) AS n FROM v JOIN e USING (metric) WHERE v IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return quality_report(t.fx_p)
