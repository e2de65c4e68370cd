"""Windows over tracks: stays, sequences, segments, histories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekspark.functions.geo import haversine_m
from trekspark.operators.expressions import HOPS_SQL, STEPS_SQL, hop_metres, steps, track_order
from trekspark.operators.filters import CLEAN_SQL, drop_jump_tracks
from trekspark.plans.registry import query


def detect_stays(points: DataFrame, max_kmh: float = 1.0, min_s: float = 30.0, min_points: int = 1) -> DataFrame:
    """stay: whether the point is in a maximal run of slow points (NULL speed is not slow) that lasts ``min_s``."""
    slow = F.coalesce(F.col("speed_kmh") <= max_kmh, F.lit(False))
    run = F.row_number().over(track_order()) - F.row_number().over(Window.partitionBy("track_id", "_slow").orderBy("t_s", "event_id"))
    w = Window.partitionBy("track_id", "_slow", "_run")
    marked = points.withColumn("_slow", slow).withColumn("_run", run)
    lasts = (F.max("t_s").over(w) - F.min("t_s").over(w) >= min_s) & (F.count("*").over(w) >= min_points)
    return marked.withColumn("stay", F.col("_slow") & lasts).drop("_slow", "_run")


STAYS_SQL = f"{CLEAN_SQL}, sl AS (SELECT *, coalesce(speed_kmh <= 1, false) AS slow FROM good), ru AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) - row_number() OVER (PARTITION BY track_id, slow ORDER BY t_s, event_id) AS run FROM sl), stays AS (SELECT track_id, scene, event_id, t_s, lon, lat, slow AND max(t_s) OVER w - min(t_s) OVER w >= 30 AS stay FROM ru WINDOW w AS (PARTITION BY track_id, slow, run))"


@query("detect_stays", f"WITH {STAYS_SQL} SELECT track_id, event_id, stay FROM stays")
def _(t):
    return detect_stays(drop_jump_tracks(t.fx_p)).select("track_id", "event_id", "stay")


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """region_id and distance (planar degrees) of the scene's nearest centroid, ties to the smaller id.
    A scene's centroids travel as one array, so rows are not multiplied."""
    c = centroids.groupBy("scene").agg(F.collect_list(F.struct("region_id", "lon", "lat")).alias("_c"))
    best = F.array_min(F.transform("_c", lambda x: F.struct(F.sqrt((x.lon - F.col("lon")) * (x.lon - F.col("lon")) + (x.lat - F.col("lat")) * (x.lat - F.col("lat"))).alias("d"), x.region_id.alias("region_id"))))
    return points.join(c, "scene").withColumn("_b", best).select(points["*"], F.col("_b.region_id").alias("region_id"), F.col("_b.d").alias("region_dist"))


NEAREST_SQL = "nc AS (SELECT track_id, event_id, t_s, scene, lon, lat, region_id, d FROM (SELECT p.*, c.region_id, sqrt((c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat)) AS d, row_number() OVER (PARTITION BY p.track_id, p.event_id ORDER BY sqrt((c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat)), c.region_id) AS k FROM {src} p JOIN fx_c c ON c.scene = p.scene) WHERE k = 1)"


@query("nearest_centroid", f"WITH {NEAREST_SQL.format(src='fx_p')} SELECT track_id, event_id, region_id, round(d, 6) AS region_dist FROM nc")
def _(t):
    return nearest_centroid(t.fx_p, t.fx_c).select("track_id", "event_id", "region_id", F.round("region_dist", 6).alias("region_dist"))


def compress_sequence(visits: DataFrame) -> DataFrame:
    """Visits without consecutive repeats of a region; returns to a region stay."""
    before = F.lag("region_id").over(track_order())
    return visits.withColumn("_b", before).where("_b is null or _b != region_id").drop("_b")


def sequences(visits: DataFrame) -> DataFrame:
    """(track_id, seq): compressed region sequence per track, in time order."""
    rows = compress_sequence(visits).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("t_s", "event_id", "region_id"))).alias("_s"))
    return rows.select("track_id", F.col("_s.region_id").alias("seq"))


@query("compress_sequence", "WITH c AS (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM fx_r) SELECT track_id, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY t_s, event_id) AS seq FROM c WHERE b IS NULL OR b <> region_id GROUP BY track_id")
def _(t):
    return sequences(t.fx_r).select("track_id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


def transition_counts(visits: DataFrame) -> DataFrame:
    """(region_id, nxt, n) over consecutive visits of a track."""
    return steps(visits).where("nxt is not null").groupBy("region_id", "nxt").agg(F.count("*").alias("n"))


@query("transition_counts", f"WITH {STAYS_SQL}, st0 AS (SELECT * FROM stays WHERE stay), {NEAREST_SQL.format(src='st0')}, c AS (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM nc), d AS (SELECT * FROM c WHERE b IS NULL OR b <> region_id), l AS (SELECT region_id, lead(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS nxt FROM d) SELECT region_id, nxt, count(*) AS n FROM l WHERE nxt IS NOT NULL GROUP BY 1, 2")
def _(t):
    stays = detect_stays(drop_jump_tracks(t.fx_p)).where("stay")
    return transition_counts(compress_sequence(nearest_centroid(stays, t.fx_c)))


def first_visits(visits: DataFrame) -> DataFrame:
    """(track_id, region_id, t_s, visit): first arrival at each region, and its order from 1."""
    first = visits.groupBy("track_id", "region_id").agg(F.min(F.struct("t_s", "event_id")).alias("_f"))
    return first.select("track_id", "region_id", "_f.t_s", F.row_number().over(Window.partitionBy("track_id").orderBy("_f")).alias("visit"))


@query("first_visits", "WITH f AS (SELECT track_id, region_id, min((t_s, event_id)) AS f, min(t_s) AS t_s FROM fx_r GROUP BY 1, 2) SELECT track_id, region_id, t_s, CAST(row_number() OVER (PARTITION BY track_id ORDER BY f) AS INT) AS visit FROM f")
def _(t):
    return first_visits(t.fx_r)


def distance_segments(points: DataFrame, length_m: float = 500.0) -> DataFrame:
    """(track_id, event_id, seg): a segment closes at the first point at least ``length_m`` after its start,
    and that point starts the next. A cut depends on the one before, so a track is read in order."""

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t_s", "event_id"])
        hops, starts, at = g.hop_m.fillna(0.0).to_numpy(), [], 0
        gone = np.concatenate([[0.0], np.cumsum(hops)])
        while at < len(hops):  # a round a segment: the running sum names hops that surely are not enough, the sum from the segment's start decides
            near = max(at, int(np.searchsorted(gone, gone[at] + length_m * (1 - 1e-9))) - 1)
            since = float(np.add.accumulate(hops[at:near])[-1]) if near > at else 0.0
            while near < len(hops) and since < length_m:
                since, near = since + hops[near], near + 1
            if since < length_m:
                break
            starts.append(near - 1)
            at = near
        seg = np.zeros(len(hops), np.int32)
        seg[starts] = 1
        return pd.DataFrame({"track_id": g.track_id, "event_id": g.event_id, "seg": np.cumsum(seg, dtype=np.int32)})

    hops = hop_metres(points).select("track_id", "event_id", "t_s", "hop_m")
    return hops.groupBy("track_id").applyInPandas(cut, "track_id long, event_id long, seg int")


@query("distance_segments", f"""WITH RECURSIVE h AS (SELECT track_id, event_id, coalesce(hop_m, 0e0) AS hop, row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS k FROM ({HOPS_SQL})),
r AS (SELECT track_id, event_id, k, 0 AS seg, 0e0 AS since FROM h WHERE k = 1 UNION ALL SELECT h.track_id, h.event_id, h.k, CASE WHEN r.since + h.hop >= 100 THEN r.seg + 1 ELSE r.seg END, CASE WHEN r.since + h.hop >= 100 THEN 0e0 ELSE r.since + h.hop END FROM r JOIN h ON h.track_id = r.track_id AND h.k = r.k + 1)
SELECT track_id, event_id, seg FROM r""")
def _(t):
    return distance_segments(t.fx_p, 100.0)


def sample_equidistant(points: DataFrame, n: int = 10) -> DataFrame:
    """(track_id, i, lon, lat): the points at ``n`` evenly spaced positions (cut to whole numbers) of each track."""
    rows = points.withColumns({"_k": F.row_number().over(track_order()) - 1, "_n": F.count("*").over(Window.partitionBy("track_id"))})
    wanted = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.lit(i) * (F.col("_n") - 1) / (n - 1)).alias("k")) for i in range(n))), lambda x: x.k == F.col("_k"))
    return rows.select("track_id", "lon", "lat", F.explode(wanted).alias("_w")).select("track_id", F.col("_w.i").alias("i"), "lon", "lat")


@query("sample_equidistant", "WITH k AS (SELECT track_id, lon, lat, row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM fx_p) SELECT track_id, CAST(i AS INT) AS i, lon, lat FROM k JOIN (SELECT unnest(range(10)) AS i) r ON CAST(floor(i * (n - 1) / 9e0) AS BIGINT) = k")
def _(t):
    return sample_equidistant(t.fx_p)


def propagate_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels of -1 take the last label before them along the track, else the first after."""
    known = F.when(F.col(label) >= 0, F.col(label))
    after = track_order().rowsBetween(0, Window.unboundedFollowing)
    before = track_order().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(label, F.coalesce(F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after), F.lit(-1)))


@query("propagate_labels", "WITH k AS (SELECT *, CASE WHEN region_id % 3 = 0 THEN region_id END AS r FROM fx_r) SELECT track_id, event_id, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(r IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t_s, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS region_id FROM k")
def _(t):
    gaps = t.fx_r.withColumn("region_id", F.when(F.col("region_id") % 3 == 0, F.col("region_id")).otherwise(-1))
    return propagate_labels(gaps, "region_id").select("track_id", "event_id", "region_id")


def history(df: DataFrame) -> DataFrame:
    """Means over a step's earlier steps only: n_before, mean_dur, and the time since the track's start."""
    earlier = track_order().rowsBetween(Window.unboundedPreceding, -1)
    return steps(df).withColumns({"n_before": F.count("dur").over(earlier), "mean_dur": F.avg("dur").over(earlier), "elapsed": F.col("t_s") - F.min("t_s").over(Window.partitionBy("track_id"))})


@query("history_features", f"WITH {STEPS_SQL} SELECT track_id, event_id, count(dur) OVER w AS n_before, round(avg(dur) OVER w, 4) AS mean_dur, t_s - min(t_s) OVER (PARTITION BY track_id) AS elapsed FROM st WINDOW w AS (PARTITION BY track_id ORDER BY t_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    return history(t.fx_r).select("track_id", "event_id", "n_before", F.round("mean_dur", 4).alias("mean_dur"), "elapsed")


def sliding_windows(segments: DataFrame, length: int, min_history: int = 7) -> DataFrame:
    """(track, seg_idx, climbs, dur_s): the last ``length`` segments up to each target from ``min_history`` on."""
    w = Window.partitionBy("track").orderBy("seg_idx")
    rows = segments.withColumns({"_w": F.collect_list("up_m").over(w.rowsBetween(1 - length, 0)), "_i": F.row_number().over(w) - 1})
    return rows.where(F.col("_i") >= min_history).select("track", "seg_idx", F.col("_w").alias("climbs"), "dur_s")


@query("sliding_windows", "WITH w AS (SELECT track, seg_idx, dur_s, sum(up_m) OVER (PARTITION BY track ORDER BY seg_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY track ORDER BY seg_idx) - 1 AS i FROM fx_s) SELECT track, seg_idx, round(s + 1e-7, 3) AS climb, dur_s FROM w WHERE i >= 3")
def _(t):
    return sliding_windows(t.fx_s, 4, 3).select("track", "seg_idx", F.round(F.aggregate("climbs", F.lit(0.0), lambda a, x: a + x) + 1e-7, 3).alias("climb"), "dur_s")


def interpolate_nulls(df: DataFrame, value: str) -> DataFrame:
    """Linear by position inside gaps, the nearest value at the ends, NULL if there is none."""
    order = track_order()
    rows = df.withColumn("_i", F.row_number().over(order))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumns({"_a": F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    return rows.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)).drop("_i", "_a", "_b")


@query("interpolate_nulls", "WITH k AS (SELECT track_id, event_id, t_s, CASE WHEN event_id % 3 = 0 THEN ele END AS v, row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS i FROM fx_p), b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia, last_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib, first_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM k) SELECT track_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN ia IS NULL THEN vb WHEN ib IS NULL THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END, 4) AS ele FROM b")
def _(t):
    gaps = t.fx_p.select("track_id", "event_id", "t_s", F.when(F.col("event_id") % 3 == 0, F.col("ele")).alias("ele"))
    return interpolate_nulls(gaps, "ele").select("track_id", "event_id", F.round("ele", 4).alias("ele"))


@query("cumulative_arrivals", f"WITH {STEPS_SQL} SELECT track_id, pos, coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arrival FROM st")
def _(t):
    return steps(t.fx_r).withColumn("arrival", F.coalesce(F.sum("dur").over(track_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("track_id", "pos", "arrival")


def region_transitions(visits: DataFrame) -> DataFrame:
    """One row per change of region between runs: from, to, the runs' start times and the from run's stops."""
    stops = F.sum("is_stop").over(track_order().rowsBetween(Window.unboundedPreceding, -1))
    runs = compress_sequence(visits.withColumn("_stops", F.coalesce(stops, F.lit(0))))
    nxt = runs.withColumns({"region_to": F.lead("region_id").over(track_order()), "t_end": F.lead("t_s").over(track_order()), "_next": F.lead("_stops").over(track_order())})
    return nxt.where("region_to is not null").select("track_id", F.col("region_id").alias("region_from"), "region_to", F.col("t_s").alias("t_start"), "t_end", (F.col("_next") - F.col("_stops")).alias("stops"))


@query("region_transitions", "WITH a AS (SELECT *, coalesce(sum(is_stop) OVER (PARTITION BY track_id ORDER BY t_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM fx_r), r AS (SELECT * FROM a WHERE b IS NULL OR b <> region_id), n AS (SELECT track_id, region_id AS region_from, lead(region_id) OVER w AS region_to, t_s AS t_start, lead(t_s) OVER w AS t_end, CAST(lead(c) OVER w - c AS BIGINT) AS stops FROM r WINDOW w AS (PARTITION BY track_id ORDER BY t_s, event_id)) SELECT * FROM n WHERE region_to IS NOT NULL")
def _(t):
    return region_transitions(t.fx_r)
