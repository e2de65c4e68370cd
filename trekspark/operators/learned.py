"""Records and samples for forecasters, retrieval and regression forecasts, their scores, and cluster scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.graph import stored
from trekspark.operators.expressions import HOPS_SQL, STEPS_SQL, hop_metres, steps
from trekspark.operators.forecast import most_frequent
from trekspark.operators.spatial import BALLS_SQL, ball_stats, planar, planar_sql
from trekspark.operators.statistics import SEQS_SQL, prefix_rows
from trekspark.operators.trajectory import NEAREST_SQL, nearest_centroid, sequences
from trekspark.plans.registry import query

LENGTH = 8


def segment_terrain(points: DataFrame, keys: list[str]) -> DataFrame:
    """Climb, descent, mean and largest grade, mean and first elevation and duration of each segment; the change from the
    segment before counts for neither."""
    w = Window.partitionBy(*keys).orderBy("t_s", "event_id")
    d = points.withColumns({"dz": F.col("ele") - F.lag("ele").over(w), "dx": F.when(F.lag("ele").over(w).isNotNull(), F.col("hop_m"))})
    grade = F.when(F.col("dx") > 0, F.abs(F.col("dz") / F.col("dx")))
    first = F.min(F.struct("t_s", "event_id", "ele"))
    return d.groupBy(*keys).agg(F.coalesce(F.sum(F.greatest("dz", F.lit(0.0))), F.lit(0.0)).alias("up_m"), F.coalesce(-F.sum(F.least("dz", F.lit(0.0))), F.lit(0.0)).alias("down_m"), (F.sum("dz") / F.nullif(F.sum("dx"), F.lit(0.0))).alias("mean_grade"), F.max(grade).alias("max_grade"), F.avg("ele").alias("elev_mean"), first.alias("_f"), (F.max("t_s") - F.min("t_s")).alias("dur_s")).withColumn("start_ele", F.col("_f.ele")).drop("_f")


TERRAIN_SQL = """z AS (SELECT track_id, CAST(floor((row_number() OVER o - 1) / 20e0) AS INT) AS seg, event_id, t_s, CAST(ele AS DOUBLE) AS ele, hop_m FROM h WINDOW o AS (PARTITION BY track_id ORDER BY t_s, event_id)),
d AS (SELECT *, ele - lag(ele) OVER w AS dz, CASE WHEN lag(ele) OVER w IS NOT NULL THEN hop_m END AS dx FROM z WINDOW w AS (PARTITION BY track_id, seg ORDER BY t_s, event_id))"""


@query("segment_terrain", f"""WITH h AS ({HOPS_SQL}), {TERRAIN_SQL}
SELECT track_id, seg, coalesce(sum(greatest(dz, 0e0)), 0e0) AS up_m, coalesce(-sum(least(dz, 0e0)), 0e0) AS down_m, round(sum(dz) / nullif(sum(dx), 0e0), 5) AS mean_grade, round(max(CASE WHEN dx > 0 THEN abs(dz / dx) END), 4) AS max_grade, round(avg(ele), 4) AS elev_mean, max(t_s) - min(t_s) AS dur_s, arg_min(ele, (t_s, event_id)) AS start_ele FROM d GROUP BY 1, 2""")
def _(t):
    w = Window.partitionBy("track_id").orderBy("t_s", "event_id")
    z = hop_metres(t.fx_p).withColumns({"seg": F.floor((F.row_number().over(w) - 1) / 20).cast("int"), "ele": F.col("ele").cast("double")})
    s = segment_terrain(z, ["track_id", "seg"])
    return s.withColumns({"mean_grade": F.round("mean_grade", 5), "max_grade": F.round("max_grade", 4), "elev_mean": F.round("elev_mean", 4)})


def build_records(visits: DataFrame) -> DataFrame:
    """A record per step of each track: region, duration, arrival since the start, hour of the start, and sine and cosine of
    the step's time of day."""
    start = F.min("t_s").over(Window.partitionBy("track_id"))
    angle = 2 * np.pi * ((F.col("t_s") / 3600) % 24) / 24
    return steps(visits).select("track_id", "pos", "region_id", F.col("dur").alias("dur_s"), (F.col("t_s") - start).alias("arrival_s"), ((start / 3600) % 24).alias("start_hour"), F.sin(angle).alias("tod_sin"), F.cos(angle).alias("tod_cos"))


@query("build_records", f"WITH {STEPS_SQL} SELECT track_id, pos, region_id, dur AS dur_s, t_s - min(t_s) OVER (PARTITION BY track_id) AS arrival_s, round((min(t_s) OVER (PARTITION BY track_id) / 36e2) % 24, 5) AS start_hour, round(sin(2 * pi() * ((t_s / 36e2) % 24) / 24), 5) + 0e0 AS tod_sin, round(cos(2 * pi() * ((t_s / 36e2) % 24) / 24), 5) + 0e0 AS tod_cos FROM st")
def _(t):
    r = build_records(t.fx_r)
    return r.withColumns({"start_hour": F.round("start_hour", 5), "tod_sin": F.round("tod_sin", 5) + 0.0, "tod_cos": F.round("tod_cos", 5) + 0.0})


def model_samples(seqs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(track_id, ids, targets, mask): the first ``length`` regions (from 1, 0 pads), the regions shifted by one, and which targets are there."""
    padded = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0), length)), 1, length)
    ids = F.transform("seq", lambda x: (x + 1).cast("int"))
    targets = padded(F.slice(ids, 2, length))
    return seqs.select("track_id", padded(ids).alias("ids"), targets.alias("targets"), F.transform(targets, lambda x: (x > 0).cast("int")).alias("mask"))


@query("model_samples", f"WITH {SEQS_SQL}, p AS (SELECT track_id, list_transform(range(1, 10), lambda i: CASE WHEN i <= len(seq) THEN seq[i] + 1 ELSE 0 END) AS x FROM sq) SELECT track_id, array_to_string(x[1:8], ',') AS ids, array_to_string(x[2:9], ',') AS targets, array_to_string(list_transform(x[2:9], lambda y: CASE WHEN y > 0 THEN 1 ELSE 0 END), ',') AS mask FROM p")
def _(t):
    return model_samples(sequences(t.fx_r)).select("track_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "targets", "mask")))


def masked_samples(visits: DataFrame, share: float = 0.2) -> DataFrame:
    """Steps of tracks with three or more, of which some inner one is masked: input (NULL where masked) and target (NULL
    elsewhere). A step is masked by the md5 of track and position."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "track_id", "pos")), 1, 4), 16, 10).cast("int")
    s = steps(visits).withColumn("n", n).where("n >= 3").withColumn("masked", (F.col("pos") > 1) & (F.col("pos") < F.col("n")) & (h < int(65536 * share)))
    s = s.withColumn("some", F.max("masked").over(Window.partitionBy("track_id"))).where("some")
    return s.select("track_id", "pos", F.when(~F.col("masked"), F.col("region_id")).alias("input"), F.when(F.col("masked"), F.col("region_id")).alias("target"))


@query("masked_samples", f"WITH {STEPS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM st), m AS (SELECT *, pos > 1 AND pos < n AND CAST('0x' || substr(md5(CAST(track_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), 1, 4) AS INT) < 13107 AS masked FROM n WHERE n >= 3), s AS (SELECT *, bool_or(masked) OVER (PARTITION BY track_id) AS hit FROM m) SELECT track_id, pos, CASE WHEN NOT masked THEN region_id END AS input, CASE WHEN masked THEN region_id END AS target FROM s WHERE hit")
def _(t):
    return masked_samples(t.fx_r)


def flat_step_features(visits: DataFrame) -> DataFrame:
    """One row per step after the first: position, steps, from, to, and time and steps with a stop so far."""
    before = Window.partitionBy("track_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = steps(visits).withColumns({"n": F.count("*").over(Window.partitionBy("track_id")), "time_so_far": F.sum("dur").over(before), "stops_so_far": F.sum("is_stop").over(before)})
    return s.where("pos > 1 and nxt is not null").select("track_id", "pos", "n", F.col("region_id").alias("from_region"), F.col("nxt").alias("to_region"), "time_so_far", "stops_so_far", "dur")


@query("flat_step_features", f"WITH {STEPS_SQL}, f AS (SELECT track_id, pos, count(*) OVER (PARTITION BY track_id) AS n, region_id AS from_region, nxt AS to_region, sum(dur) OVER b AS time_so_far, CAST(sum(is_stop) OVER b AS BIGINT) AS stops_so_far, dur FROM st WINDOW b AS (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM f WHERE pos > 1 AND to_region IS NOT NULL")
def _(t):
    return flat_step_features(t.fx_r)


# Route forecasts


def route_votes(test: DataFrame, train: DataFrame, prefix: int = 5, k: int = 5) -> DataFrame:
    """(track_id, route_id): the route of most of the ``k`` train tracks that share the longest prefix (up to ``prefix``
    regions) with the test track, ties to smaller track ids, then to the smaller route. Train rows are cut to k per
    prefix before tracks meet."""
    p = prefix_rows(train, prefix)
    first = Window.partitionBy("prefix").orderBy("track_id")
    kept = p.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("prefix", F.col("track_id").alias("t"), "route_id")
    met = prefix_rows(test, prefix).join(kept, "prefix").groupBy("track_id", "t", "route_id").agg(F.max("m").alias("lcp"))
    by = Window.partitionBy("track_id").orderBy(F.desc("lcp"), "t")
    best = met.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k)
    return most_frequent(best, ["track_id"], "route_id").select("track_id", "route_id")


VOTES_SQL = f"{SEQS_SQL}, ro AS (SELECT DISTINCT track_id, route_id FROM fx_r), px AS (SELECT track_id, m, array_to_string(seq[1:m], ',') AS prefix FROM sq, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE m <= len(seq)), lc AS (SELECT a.track_id, b.track_id AS t, max(a.m) AS lcp FROM px a JOIN px b ON a.prefix = b.prefix WHERE a.track_id % 10 >= 7 AND b.track_id % 10 < 7 GROUP BY 1, 2), k5 AS (SELECT track_id, route_id FROM (SELECT lc.track_id, ro.route_id, row_number() OVER (PARTITION BY lc.track_id ORDER BY lcp DESC, t) AS k FROM lc JOIN ro ON ro.track_id = lc.t) WHERE k <= 5), vo AS (SELECT track_id, route_id FROM (SELECT track_id, route_id, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, route_id) AS k FROM k5 GROUP BY 1, 2) WHERE k = 1)"


def _voted(t):
    s = sequences(t.fx_r)
    routed = s.join(t.fx_r.select("track_id", "route_id").distinct(), "track_id")
    return route_votes(s.where("track_id % 10 >= 7"), routed.where("track_id % 10 < 7"))


@query("prefix_vote_route", f"WITH {VOTES_SQL} SELECT track_id, route_id FROM vo")
def _(t):
    return _voted(t)


@query("route_scores", f"WITH {VOTES_SQL}, mj AS (SELECT route_id FROM ro WHERE track_id % 10 < 7 GROUP BY 1 ORDER BY count(*) DESC, route_id LIMIT 1) SELECT count(*) AS n, round(avg(CASE WHEN vo.route_id = ro.route_id THEN 1e0 ELSE 0e0 END), 6) AS voted, round(avg(CASE WHEN mj.route_id = ro.route_id THEN 1e0 ELSE 0e0 END), 6) AS majority FROM ro LEFT JOIN vo USING (track_id) CROSS JOIN mj WHERE ro.track_id % 10 >= 7")
def _(t):
    true = t.fx_r.select("track_id", "route_id").distinct()
    major = most_frequent(true.where("track_id % 10 < 7").withColumn("_g", F.lit(1)), ["_g"], "route_id").select(F.col("route_id").alias("_m"))
    both = true.where("track_id % 10 >= 7").join(_voted(t).withColumnRenamed("route_id", "_v"), "track_id", "left").join(F.broadcast(major))  # one row
    hit = lambda c: F.round(F.avg(F.when(F.col(c) == F.col("route_id"), 1.0).otherwise(0.0)), 6)
    return both.agg(F.count("*").alias("n"), hit("_v").alias("voted"), hit("_m").alias("majority"))


def template_suffix(test: DataFrame, templates: DataFrame, prefix: int = 3) -> DataFrame:
    """(track_id, route_id, lcp, suffix): the route whose template shares the longest prefix (up to ``prefix``) with the
    track, ties to the larger route, then the smaller id, and the rest of its template. Templates: (route_id, n, seq)."""
    p = prefix_rows(templates, prefix).select("prefix", "route_id", "n", F.col("seq").alias("whole"))
    met = prefix_rows(test, prefix).join(p, "prefix")
    best = met.groupBy("track_id").agg(F.max(F.struct("m", "n", (-F.col("route_id")).alias("_r"), "whole")).alias("b"))
    return best.select("track_id", (-F.col("b._r")).alias("route_id"), F.col("b.m").alias("lcp"), F.expr("slice(b.whole, b.m + 1, greatest(size(b.whole) - b.m, 0))").alias("suffix"))


TEMPLATES_SQL = f"{SEQS_SQL}, ro AS (SELECT DISTINCT track_id, route_id FROM fx_r WHERE track_id % 10 < 7), tm AS (SELECT route_id, seq AS whole, total AS n FROM (SELECT route_id, seq, sum(count(*)) OVER (PARTITION BY route_id) AS total, row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, array_to_string(list_transform(seq, lambda x: chr(97 + x)), '')) AS k FROM sq JOIN ro USING (track_id) GROUP BY 1, 2) WHERE k = 1), ms AS (SELECT track_id, route_id, n, m, whole FROM sq, (VALUES (1), (2), (3)) v(m), tm WHERE track_id % 10 >= 7 AND m <= len(seq) AND m <= len(whole) AND seq[1:m] = whole[1:m]), ts AS (SELECT track_id, route_id, m AS lcp, whole[m + 1:] AS suffix FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY m DESC, n DESC, route_id) AS k FROM ms) WHERE k = 1)"


def route_sequence_templates(t) -> DataFrame:
    """(route_id, n, seq): each route's most common train sequence, ties to the smaller one, and its train tracks."""
    s = sequences(t.fx_r).join(t.fx_r.select("track_id", "route_id").distinct(), "track_id").where("track_id % 10 < 7")
    n = s.groupBy("route_id").agg(F.count("*").alias("n"))
    return most_frequent(s, ["route_id"], "seq").select("route_id", "seq").join(n, "route_id").select("route_id", "n", "seq")


@query("template_suffix", f"WITH {TEMPLATES_SQL} SELECT track_id, route_id, lcp, array_to_string(suffix, ',') AS suffix FROM ts")
def _(t):
    out = template_suffix(sequences(t.fx_r).where("track_id % 10 >= 7"), route_sequence_templates(t))
    return out.withColumn("suffix", F.array_join(F.col("suffix").cast("array<string>"), ","))


@query("suffix_scores", f"WITH {TEMPLATES_SQL}, x AS (SELECT sq.track_id, ts.suffix AS p, sq.seq[ts.lcp + 1:] AS r FROM ts JOIN sq USING (track_id)) SELECT count(*) AS n, round(avg(CASE WHEN len(r) > 0 AND len(p) > 0 AND r[1] = p[1] THEN 1e0 ELSE 0e0 END), 6) AS next_hit, round(avg(CASE WHEN r = p THEN 1e0 ELSE 0e0 END), 6) AS exact, round(avg(abs(len(r) - len(p)) + len(list_filter(range(1, least(len(r), len(p)) + 1), lambda i: r[i] <> p[i]))), 5) AS gap FROM x")
def _(t):
    s = sequences(t.fx_r).where("track_id % 10 >= 7")
    x = template_suffix(s, route_sequence_templates(t)).join(s, "track_id")
    x = x.select(F.col("suffix").alias("p"), F.expr("slice(seq, lcp + 1, greatest(size(seq) - lcp, 0))").alias("r"))
    hit = F.coalesce(F.get("r", F.lit(0)) == F.get("p", F.lit(0)), F.lit(False)).cast("double")
    gap = F.abs(F.size("r") - F.size("p")) + F.size(F.filter(F.zip_with("r", "p", lambda a, b: F.coalesce(a != b, F.lit(False))), lambda y: y))
    return x.agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("next_hit"), F.round(F.avg((F.col("r") == F.col("p")).cast("double")), 6).alias("exact"), F.round(F.avg(gap), 5).alias("gap"))


@query("nearest_route", f"WITH {TEMPLATES_SQL}, ls AS (SELECT track_id, array_to_string(list_transform(seq, lambda x: chr(97 + x)), '') AS s FROM sq WHERE track_id % 10 >= 7), d AS (SELECT track_id, route_id, levenshtein(s, r) / CAST(greatest(length(s), length(r)) AS DOUBLE) AS d FROM ls, (SELECT route_id, array_to_string(list_transform(whole, lambda x: chr(97 + x)), '') AS r FROM tm)) SELECT track_id, route_id, round(d, 6) AS dist, d < 5e-1 AS near FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY d, route_id) AS k FROM d) WHERE k = 1")
def _(t):
    return nearest_route(sequences(t.fx_r).where("track_id % 10 >= 7"), route_sequence_templates(t)).withColumn("dist", F.round("dist", 6))


def nearest_route(test: DataFrame, templates: DataFrame) -> DataFrame:
    """(track_id, route_id, dist, near): the template with the smallest edit distance over the longer length, ties to the
    smaller route. Routes are few and travel as one array; regions (0 to 55,000) are characters."""
    letters = F.decode(F.unhex(F.array_join(F.transform("seq", lambda x: F.lpad(F.hex(x + 256), 4, "0")), "")), "UTF-16BE")  # a character a region
    routes = templates.select(F.struct("route_id", letters.alias("s")).alias("r")).agg(F.collect_list("r").alias("routes"))
    away = lambda r: F.struct((F.levenshtein(F.col("s"), r.s) / F.greatest(F.length("s"), F.length(r.s))).alias("dist"), r.route_id.alias("route_id"))
    met = test.select("track_id", letters.alias("s")).join(F.broadcast(routes)).select("track_id", F.array_min(F.transform("routes", away)).alias("b"))  # one row
    return met.select("track_id", "b.route_id", "b.dist", (F.col("b.dist") < 0.5).alias("near"))


@query("route_position_predict", f"WITH {STEPS_SQL}, m AS (SELECT route_id, pos, median(dur) AS mu FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 AND route_id < 5 GROUP BY 1, 2), rs AS (SELECT DISTINCT route_id, region_id FROM st WHERE track_id % 10 < 7 AND route_id < 5), te AS (SELECT * FROM st WHERE nxt IS NOT NULL AND track_id % 10 >= 7), un AS (SELECT DISTINCT track_id, region_id FROM te WHERE route_id NOT IN (SELECT route_id FROM rs)), sh AS (SELECT track_id, route_id AS other FROM (SELECT un.track_id, rs.route_id, row_number() OVER (PARTITION BY un.track_id ORDER BY count(*) DESC, rs.route_id) AS k FROM un JOIN rs USING (region_id) GROUP BY 1, 2) WHERE k = 1) SELECT te.track_id, te.pos, round(coalesce(m.mu, 0e0), 3) AS pred FROM te LEFT JOIN sh USING (track_id) LEFT JOIN m ON m.route_id = coalesce(sh.other, te.route_id) AND m.pos = te.pos")
def _(t):
    s = steps(t.fx_r)
    return route_position_predict(s.where("nxt is not null and track_id % 10 >= 7"), s.where("track_id % 10 < 7 and route_id < 5")).select("track_id", "pos", F.round("pred", 3).alias("pred"))


def route_position_predict(test: DataFrame, train: DataFrame) -> DataFrame:
    """``test`` with pred: the median duration of the route and position in train; a route that train lacks takes the train
    route that shares most regions with the track (ties to the smaller id); 0 without data."""
    mu = train.where("nxt is not null").groupBy("route_id", "pos").agg(F.percentile("dur", 0.5).alias("mu"))
    regions = train.select("route_id", "region_id").distinct()
    unknown = test.join(regions.select("route_id").distinct(), "route_id", "left_anti").select("track_id", "region_id").distinct()
    other = most_frequent(unknown.join(regions, "region_id"), ["track_id"], "route_id").select("track_id", F.col("route_id").alias("_o"))
    met = test.join(other, "track_id", "left").withColumn("_r", F.coalesce("_o", "route_id"))
    return met.join(mu.select(F.col("route_id").alias("_r"), "pos", "mu"), ["_r", "pos"], "left").withColumn("pred", F.coalesce("mu", F.lit(0.0))).drop("_o", "_r", "mu")


# Regression


def ridge_duration(train: DataFrame, test: DataFrame, features: list[str], label: str = "dur_s", alpha: float = 1.0) -> DataFrame:
    """``test`` with pred: ridge regression (penalty ``alpha`` on the sum of squares, none on the intercept), 0 at least. Train rows with a
    null feature or label are left out; test rows with a null feature have a null pred, and all have without a train row."""
    gather = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    rows = gather.transform(train.where(F.col(label).isNotNull()))
    n = rows.count()
    nothing = lambda df: df.withColumn("pred", F.lit(None).cast("double"))
    if not n:
        return nothing(test)
    model = LinearRegression(featuresCol="_x", labelCol=label, predictionCol="_p", regParam=alpha / n, elasticNetParam=0.0, standardization=False, solver="normal").fit(rows)
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in features)
    known = model.transform(gather.transform(test.where(there))).withColumn("pred", F.greatest("_p", F.lit(0.0))).drop("_x", "_p")
    return known.unionByName(nothing(test.where(f"NOT ({there})")))


@query("ridge_duration", """WITH m AS (SELECT avg(up_m) AS u, avg(down_m) AS d, avg(dur_s) AS y, stddev_samp(dur_s) AS sd, count(*) AS n FROM fx_s WHERE track % 10 < 7),
c AS (SELECT sum((up_m - u) * (up_m - u)) AS uu, sum((down_m - d) * (down_m - d)) AS dd, sum((up_m - u) * (down_m - d)) AS ud, sum((up_m - u) * (dur_s - y)) AS uy, sum((down_m - d) * (dur_s - y)) AS dy FROM fx_s, m WHERE track % 10 < 7),
b AS (SELECT (uy * (dd + 1) - dy * ud) / ((uu + 1) * (dd + 1) - ud * ud) AS bu, (dy * (uu + 1) - uy * ud) / ((uu + 1) * (dd + 1) - ud * ud) AS bd FROM c)
SELECT scene, count(*) AS n, round(avg(abs(greatest(y + bu * (up_m - u) + bd * (down_m - d), 0e0) - dur_s)), 2) AS mae FROM fx_s, m, b WHERE track % 10 >= 7 GROUP BY scene""")
def _(t):
    out = ridge_duration(t.fx_s.where("track % 10 < 7"), t.fx_s.where("track % 10 >= 7"), ["up_m", "down_m"])
    return out.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("dur_s"))), 2).alias("mae"))


CELLS = 4096  # that rows are split into, at most; larger tables have larger cells, whose rows are dealt to several groups
CELL_SAMPLE = 16  # sampled rows a cell, from which the cells' cuts are taken


def _cell_tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of a k-d tree as a heap (dimension, -1 at leaves, and value): each node is cut at the median of its widest dimension."""
    depth = max(0, cells - 1).bit_length()
    dim, cut = np.full(1 << (depth + 1), -1), np.zeros(1 << (depth + 1))
    todo = [(1, sample)] if depth and len(sample) else []
    while todo:
        node, x = todo.pop()
        wide = np.ptp(x, axis=0)
        d = int(wide.argmax())
        if not wide[d] > 0:
            continue
        v = np.sort(x[:, d])
        dim[node], cut[node] = d, min(v[(len(v) - 1) // 2], v[v < v[-1]][-1])
        if 2 * node < 1 << depth:
            beyond = x[:, d] > cut[node]
            todo += [(2 * node, x[~beyond]), (2 * node + 1, x[beyond])]
    return dim, cut


def _cell_of(x: np.ndarray, dim: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, at = np.ones(len(x), np.int64), np.arange(len(x))
    for _ in range(len(dim).bit_length() - 2):
        d = dim[node]
        node = np.where(d >= 0, 2 * node + (x[at, d] > cut[node]), node)
    return node


def _nearest_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, names: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple]:
    """(query, row, distance) of the ``k`` nearest of rows ``x`` to each of ``q``, up to its bound. Distances by a matrix product tell which rows may be among
    them, with room for what it rounds; theirs are then worked out one by one."""
    centre, out = x.mean(axis=0), []
    near, far = x - centre, q - centre
    square = (near * near).sum(axis=1)
    step = max(1, (1 << 22) // len(x))
    for a in range(0, len(q), step):
        y = far[a : a + step]
        own = (y * y).sum(axis=1)
        d2 = square - 2 * (y @ near.T) + own[:, None]
        limit = bounds[a : a + step] ** 2
        if len(x) > k + 1:  # one more, as a query's own row does not count
            unknown = ~np.isfinite(limit)
            limit[unknown] = np.partition(d2[unknown], k, axis=1)[:, k]
        limit = np.maximum(limit, 0)
        limit = limit + 4e-9 * np.sqrt(limit) + 1e-11 * (square.max() + own) + 1e-17
        for i in range(len(y)):
            at = np.flatnonzero(~(d2[i] > limit[i]))
            d = np.round(np.sqrt(((x[at] - q[a + i]) ** 2).sum(axis=1)), 9)
            d[ids[at] == names[a + i]] = np.inf
            out += [(names[a + i], ids[at[j]], d[j]) for j in np.lexsort((ids[at], d))[:k] if np.isfinite(d[j])]
    return out


LEAF, LOW = 64, 8  # rows of a leaf; dimensions up to which leaves tell rows apart better than a matrix product


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows of ``x`` (no two alike) in leaves of at most LEAF, cut at the median of the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        half = len(own) // 2
        own = own[np.argpartition(x[own, np.ptp(x[own], axis=0).argmax()], half)]
        todo += [own[:half], own[half:]]
    return out


def _nearest_by_leaves(x: np.ndarray, ids: np.ndarray, q: np.ndarray, names: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_nearest_of`` for few dimensions, as arrays: each query is compared with the rows of the leaves that its bound reaches, the bound being the k-th
    distance in its nearest leaves. Of rows at one place only the k + 1 smallest ids can count, so no more are kept."""
    order = np.lexsort((ids, *x.T))
    x, ids = x[order], ids[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
    many = np.diff(new, append=len(x))
    places, kept = x[new], np.minimum(many, k + 1)
    leaves = _leaves(places)
    low, high = (np.stack([f(places[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    out = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]

    def met(some: np.ndarray, at: np.ndarray, limit: np.ndarray | None) -> tuple:
        """Queries ``some`` with rows of the places ``at`` within ``limit``: (query, row, distance); all of them and no rows without a limit."""
        d2 = np.zeros((len(some), len(at)))
        for c in range(x.shape[1]):
            d2 += (q[some, c, None] - places[at, c]) ** 2
        if limit is None:
            return d2
        i, j = np.nonzero(d2 <= limit[:, None])
        times = kept[at[j]]
        i, row = np.repeat(i, times), np.repeat(new[at[j]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return some[i], row

    step = max(1, (1 << 21) // len(leaves))
    for a in range(0, len(q), step):
        mine = np.arange(a, min(len(q), a + step))
        gap = np.zeros((len(mine), len(leaves)))
        for c in range(x.shape[1]):
            gap += np.maximum(0, np.maximum(low[:, c] - q[mine, c, None], q[mine, c, None] - high[:, c])) ** 2
        limit = bounds[mine] ** 2
        home = gap.argmin(axis=1)
        for n in np.unique(home[~np.isfinite(limit)]):
            at = leaves[n]
            some = np.flatnonzero((home == n) & ~np.isfinite(limit))
            if len(at) > k + 1:  # places, each with a row: one more, as a query's own row does not count
                limit[some] = np.partition(met(mine[some], at, None), k, axis=1)[:, k]
        root = np.sqrt(limit)
        limit = (root * (1 + 1e-12) + 2e-9) ** 2
        i, n = np.nonzero(gap <= limit[:, None])
        by = np.argsort(n, kind="stable")
        i, n = i[by], n[by]
        found = []
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(n)) + 1):
            if len(part):
                found.append(met(mine[i[part]], leaves[n[part[0]]], limit[i[part]]))
        if not found:
            continue
        who, row = (np.concatenate(c) for c in zip(*found, strict=True))
        other = ids[row] != names[who]
        who, row = who[other], row[other]
        d = np.zeros(len(who))
        for c in range(x.shape[1]):
            d += (x[row, c] - q[who, c]) ** 2
        d = np.round(np.sqrt(d), 9)
        best = np.lexsort((ids[row], d, who))
        who, row, d = who[best], row[best], d[best]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
        top = rank < k
        out.append((names[who[top]], ids[row[top]], d[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def knn_topk(queries: DataFrame, rows: DataFrame, k: int = 5, query_block: int = 2_000, row_block: int = 20_000) -> DataFrame:
    """(q, rank, id, dist): the ``k`` nearest rows (id, v array<double>) of each query (q, v) by Euclidean distance to 9 decimals, ties to the
    smaller id, a row of the query's own id left out. Queries and rows with a null vector, or with a component that is null or not finite, take no part.

    Rows lie in cells of about ``row_block``, cut by a k-d tree over a sample (which shapes the cells, not the result). A query looks into its own
    cell first; the k-th distance there bounds which other cells can hold a nearer row or a tie, and only these are looked into. Large cells are
    dealt to groups of about ``row_block`` rows, their queries to groups of about ``query_block``, whatever the tables' size.
    """
    whole = lambda df: df.where(F.col("v").isNotNull()).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    spark = rows.sparkSession
    rows, queries = stored(whole(rows).select(F.col("id").cast("long").alias("id"), "v")), stored(whole(queries).select(F.col("q").cast("long").alias("q"), "v"))
    n = rows.count()
    cells = min(CELLS, -(-n // row_block))
    share = CELL_SAMPLE * cells / max(1, n)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) < share * 1_000_003).select("v").limit(2 * CELL_SAMPLE * cells).toArrow() if cells > 1 else None
    dim, cut = _cell_tree(np.stack(sample.column("v").to_numpy()) if sample is not None and sample.num_rows else np.zeros((0, 1)), cells)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_cell_of(np.stack(batch.v), dim, cut))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, many = {}, {}, {}
        for batch in batches:
            if not len(batch):
                continue
            x, cell = np.stack(batch.v), batch.cell.to_numpy()
            for c in np.unique(cell):
                own = x[cell == c]
                low[c] = np.minimum(low.get(c, np.inf), own.min(axis=0))
                high[c] = np.maximum(high.get(c, -np.inf), own.max(axis=0))
                many[c] = many.get(c, 0) + len(own)
        for c in low:
            yield pd.DataFrame({"cell": c, "at": np.arange(len(low[c])), "low": low[c], "high": high[c], "n": many[c]})

    held = rows.mapInPandas(celled, "id long, v array<double>, cell long") if cells > 1 else rows.withColumn("cell", F.lit(1).cast("long"))
    held = stored(held) if cells > 1 else held
    box = held.mapInPandas(boxes, "cell long, at int, low double, high double, n long").groupBy("cell", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("cell", "at").toPandas()  # two numbers a cell and dimension
    of_cell = box[box["at"] == 0].set_index("cell").n
    names = of_cell.index.to_numpy()
    low, high = (box[c].to_numpy().reshape(len(names), -1 if len(names) else 0) for c in ("low", "high"))

    def look(probes: DataFrame) -> DataFrame:
        """The best of each cell that ``probes`` (q, v, cell, bound) name."""
        asked = dict(probes.groupBy("cell").count().toPandas().itertuples(index=False))  # a row a cell
        asked = {int(c): int(m) for c, m in asked.items() if c in of_cell.index}
        spread = -(-16 // max(1, len(asked)))  # where there are few cells, so that more than one task works
        parts = [(c, -(-int(of_cell[c]) // row_block), max(-(-m // query_block), min(spread, -(-m // 250)))) for c, m in asked.items()]
        dealt = F.broadcast(spark.createDataFrame(parts, "cell long, _parts int, _blocks int"))
        span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = probes.join(dealt, "cell").withColumn("_b", F.pmod(F.xxhash64("q"), "_blocks").cast("int")).withColumn("_c", span("_parts")).select("cell", "_c", "_b", "q", "v", "bound")
        right = held.join(dealt, "cell").withColumn("_c", F.pmod(F.xxhash64("id"), "_parts").cast("int")).withColumn("_b", span("_blocks")).select("cell", "_c", "_b", "id", "v")

        def near(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            if not len(one) or not len(other):
                return pd.DataFrame([], columns=["q", "id", "dist"])
            x, y = np.stack(other.v), np.stack(one.v)
            own = (x, other.id.to_numpy(), y, one.q.to_numpy(), one.bound.to_numpy(np.float64), k)
            if x.shape[1] <= LOW:
                return pd.DataFrame(dict(zip(("q", "id", "dist"), _nearest_by_leaves(*own), strict=True)))
            return pd.DataFrame(_nearest_of(*own), columns=["q", "id", "dist"])

        by = ("cell", "_c", "_b")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, "q long, id long, dist double")

    best = Window.partitionBy("q").orderBy("dist", "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    at_home = queries.mapInPandas(celled, "q long, v array<double>, cell long") if cells > 1 else queries.withColumn("cell", F.lit(1).cast("long"))
    home = ranked(look(at_home.withColumn("bound", F.lit(float("inf")))))
    if len(names) < 2:
        return home
    home = stored(home)

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.iloc[a : a + 256]
                x, gap = np.stack(some.v), np.zeros((len(some), len(names)))
                for d in range(x.shape[1]):
                    gap += np.maximum(0, np.maximum(low[:, d] - x[:, d, None], x[:, d, None] - high[:, d])) ** 2
                bound = some.bound.to_numpy()
                i, j = np.nonzero((np.sqrt(gap) <= (bound * (1 + 1e-9) + 1e-8)[:, None]) & (names != some.cell.to_numpy()[:, None]))
                yield pd.DataFrame({"q": some.q.to_numpy()[i], "v": some.v.to_numpy()[i], "cell": names[j], "bound": bound[i]})

    reach = home.where(F.col("rank") == k).select("q", F.col("dist").alias("bound"))
    open_ = at_home.join(reach, "q", "left").select("q", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    probes = stored(open_.mapInPandas(further, "q long, v array<double>, cell long, bound double"))
    return ranked(home.select("q", "id", "dist").unionByName(look(probes)))


KNN_SQL = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), kd AS (SELECT q.vec_id AS q, r.vec_id AS id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - r.v[i]) * (q.v[i] - r.v[i])))) AS dist FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0), kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), id) AS rank FROM kd) WHERE rank <= 5)"


def _nearest(t) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return knn_topk(e.where("id % 100 = 0").withColumnRenamed("id", "q"), e)


@query("knn_topk", f"WITH {KNN_SQL} SELECT q, CAST(rank AS INT) AS rank, id, round(dist, 5) AS dist FROM kn")
def _(t):
    return _nearest(t).select("q", "rank", "id", F.round("dist", 5).alias("dist"))


KNN_FEATURES = ("dist_m", "up_m", "down_m", "elev_mean", "tod_hour")
_SCALED = ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-9) AS s_{c}" for c in KNN_FEATURES)
_NEAR = " + ".join(f"pow((q.{c} - r.{c}) / s_{c}, 2)" for c in KNN_FEATURES)


def knn_duration(train: DataFrame, test: DataFrame, features: tuple, label: str = "dur_s", k: int = 5) -> DataFrame:
    """(q, pred): the mean label of the ``k`` nearest train rows (id) of each test row (id), features scaled by their train mean and deviation. Rows with
    a null feature, and train rows without a label, take no part."""
    fit = train.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias(f"s_{c}") for c in features))
    v = F.array(*((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in features))
    scaled = lambda df: df.crossJoin(F.broadcast(fit)).select("id", F.when(~F.exists(v, lambda x: x.isNull()), v).alias("v"))  # noqa: E731  one row
    near = knn_topk(scaled(test).withColumnRenamed("id", "q"), scaled(train.where(F.col(label).isNotNull())), k, query_block=10_000)
    return near.join(train.select("id", label), "id").groupBy("q").agg(F.avg(label).alias("pred"))


@query("knn_duration", f"WITH s AS (SELECT *, track * 101 + seg_idx AS id FROM fx_s), f AS (SELECT {_SCALED} FROM s WHERE track % 10 < 7), n AS (SELECT q.id AS q, r.id, r.dur_s, row_number() OVER (PARTITION BY q.id ORDER BY round(sqrt({_NEAR}), 9), r.id) AS k FROM s q JOIN s r ON q.track % 10 >= 7 AND r.track % 10 < 7 CROSS JOIN f) SELECT q, round(avg(dur_s), 4) AS pred FROM n WHERE k <= 5 GROUP BY q")
def _(t):
    s = t.fx_s.withColumn("id", F.col("track") * 101 + F.col("seg_idx"))
    return knn_duration(s.where("track % 10 < 7"), s.where("track % 10 >= 7"), KNN_FEATURES).withColumn("pred", F.round("pred", 4))


# Scores


LEVELS = ((0.05, -1.645), (0.1, -1.282), (0.25, -0.674), (0.5, 0.0), (0.75, 0.674), (0.9, 1.282), (0.95, 1.645))


@query("quantile_scores", "WITH q AS (SELECT scene, l, true_dur AS y, mu + z * sigma AS p FROM fx_pred, (VALUES " + ", ".join(f"({int(a * 100)}e-2, {int(z * 1000)}e-3)" for a, z in LEVELS) + ") v(l, z) WHERE sigma IS NOT NULL) SELECT scene, CAST(count(*) / 7 AS BIGINT) AS n, round(2 * avg(greatest(l * (y - p), (l - 1) * (y - p))), 3) AS crps, round(sum(CASE WHEN l = 5e-2 AND y < p OR l = 95e-2 AND y > p THEN 0e0 WHEN l = 5e-2 OR l = 95e-2 THEN 1e0 END) / (count(*) / 7e0) - 1, 5) AS picp90, round(avg(CASE WHEN l = 95e-2 THEN p END) - avg(CASE WHEN l = 5e-2 THEN p END), 3) AS width, round(avg(abs(CASE WHEN y <= p THEN 1e0 ELSE 0e0 END - l)), 5) AS gap FROM q GROUP BY scene")
def _(t):
    p = t.fx_pred.where("sigma is not null").select("scene", F.col("true_dur").alias("y"), F.array(*(F.struct(F.lit(a).alias("l"), (F.col("mu") + int(z * 1000) / 1000 * F.col("sigma")).alias("p")) for a, z in LEVELS)).alias("q"))
    return quantile_scores(p, ["scene"])


def quantile_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Discrete CRPS, 90 % coverage and width, and mean gap to the level, of rows with a value ``y`` and quantiles ``q`` (level l, value p)."""
    n = len(LEVELS)
    mean = lambda f: F.aggregate("q", F.lit(0.0), lambda s, x: s + f(x)) / n
    pinball = mean(lambda x: F.greatest(x.l * (F.col("y") - x.p), (x.l - 1) * (F.col("y") - x.p)))
    low, high = F.col("q")[0].p, F.col("q")[n - 1].p
    inside = ((F.col("y") >= low) & (F.col("y") <= high)).cast("double")
    gap = mean(lambda x: F.abs((F.col("y") <= x.p).cast("double") - x.l))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(2 * F.avg(pinball), 3).alias("crps"), F.round(F.avg(inside), 5).alias("picp90"), F.round(F.avg(high) - F.avg(low), 3).alias("width"), F.round(F.avg(gap), 5).alias("gap"))


# Clusters


def ball_affinity(d: Column, r1: Column, r2: Column, delta: float) -> Column:
    """Affinity of two balls: overlapping ones by overlap, containment and balance, at most 1; others by their relative gap."""
    small, large = F.least(r1, r2), F.greatest(r1, r2)
    balance = F.abs(r1 - r2) / large
    overlap = F.least((r1 + r2 - d) / (2 * small), F.lit(1.0))
    inside = F.when(d + small <= large, 1.0).otherwise(0.0)
    near = F.least(0.7 + 0.3 * overlap + 0.1 * inside + 0.05 * (1 - balance), F.lit(1.0))
    apart = F.exp(-((d - r1 - r2) / (r1 + r2)) / (delta * (0.5 + 0.5 * (1 - balance)))) * (0.7 + 0.3 * (1 - balance))
    return F.when(small <= 0, F.exp(-10 * d)).when(d <= r1 + r2, near).otherwise(apart)


AFFINITY_SQL = f"{BALLS_SQL}, pr AS (SELECT a.scene, a.region_id AS a, b.region_id AS b, {planar_sql('a', 'b')} AS d, a.radius AS r1, b.radius AS r2, least(a.radius, b.radius) AS s, greatest(a.radius, b.radius) AS l FROM bs a JOIN bs b ON a.scene = b.scene AND a.region_id < b.region_id), af AS (SELECT *, CASE WHEN s <= 0 THEN exp(-10 * d) WHEN d <= r1 + r2 THEN least(7e-1 + 3e-1 * least((r1 + r2 - d) / (2 * s), 1e0) + CASE WHEN d + s <= l THEN 1e-1 ELSE 0e0 END + 5e-2 * (1 - abs(r1 - r2) / l), 1e0) ELSE exp(-((d - r1 - r2) / (r1 + r2)) / (5e-1 * (5e-1 + 5e-1 * (1 - abs(r1 - r2) / l)))) * (7e-1 + 3e-1 * (1 - abs(r1 - r2) / l)) END AS w FROM pr)"


def ball_affinity_graph(balls: DataFrame, delta: float = 0.5) -> DataFrame:
    """(scene, a, b, w): affinity of each pair of balls of a scene, a < b (with itself it is 1)."""
    a = balls.select("scene", F.col("region_id").alias("a"), F.col("c_lon").alias("x1"), F.col("c_lat").alias("y1"), F.col("radius").alias("r1"))
    b = balls.select("scene", F.col("region_id").alias("b"), F.col("c_lon").alias("x2"), F.col("c_lat").alias("y2"), F.col("radius").alias("r2"))
    return a.join(b, "scene").where("a < b").select("scene", "a", "b", ball_affinity(planar("x1", "y1", "x2", "y2"), F.col("r1"), F.col("r2"), delta).alias("w"))


@query("ball_affinity_graph", f"WITH {AFFINITY_SQL} SELECT scene, a, b, round(w, 5) AS w FROM af")
def _(t):
    return ball_affinity_graph(ball_stats(nearest_centroid(t.fx_p, t.fx_c), ["scene", "region_id"])).withColumn("w", F.round("w", 5))


@query("ball_affinity", f"WITH {AFFINITY_SQL} SELECT scene, count(*) AS n, round(avg(w), 5) AS mean_w, round(max(w), 5) AS max_w FROM af GROUP BY scene")
def _(t):
    g = ball_affinity_graph(ball_stats(nearest_centroid(t.fx_p, t.fx_c), ["scene", "region_id"]))
    return g.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg("w"), 5).alias("mean_w"), F.round(F.max("w"), 5).alias("max_w"))


def cluster_quality(points: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz scores, and the centroid silhouette, of labelled lon and lat, per ``keys``. Only
    centroids meet in pairs; rows meet the centroids of their key, which travel as one array."""
    cent = points.groupBy(*keys, label).agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.count("*").alias("n"))
    listed = cent.groupBy(*keys).agg(F.collect_list(F.struct(label, "x", "y")).alias("_c"), F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my"))
    far = lambda c: F.sqrt((c.x - F.col("lon")) ** 2 + (c.y - F.col("lat")) ** 2)
    own = F.array_min(F.transform(F.filter("_c", lambda c: c[label] == F.col(label)), far))
    other = F.array_min(F.transform(F.filter("_c", lambda c: c[label] != F.col(label)), far))
    d = points.join(listed.select(*keys, "_c"), keys).select(*keys, label, own.alias("a"), other.alias("b"))
    per = d.groupBy(*keys, label).agg(F.avg("a").alias("s"), F.sum(F.col("a") ** 2).alias("w"), F.sum(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("sil"))
    c = cent.join(per, [*keys, label])
    o = c.select(*keys, F.col(label).alias("_l"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    ratio = (F.col("s") + F.col("s2")) / F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    db = c.join(o, keys).where(F.col(label) != F.col("_l")).groupBy(*keys, label).agg(F.max(ratio).alias("r")).groupBy(*keys).agg(F.avg("r").alias("davies_bouldin"))
    between = F.col("n") * ((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    sums = c.join(listed.drop("_c"), keys).groupBy(*keys, "k", "total").agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.sum("sil").alias("sil"))
    return sums.join(db, keys).select(*keys, "davies_bouldin", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("total") - F.col("k")))).alias("calinski_harabasz"), (F.col("sil") / F.col("total")).alias("silhouette"))


QUALITY_SQL = f"""{NEAREST_SQL.format(src='fx_p')}, ce AS (SELECT scene, region_id, avg(lon) AS x, avg(lat) AS y, count(*) AS n FROM nc GROUP BY 1, 2),
ds AS (SELECT p.scene, p.region_id, p.track_id, p.event_id, min(CASE WHEN c.region_id = p.region_id THEN sqrt((x - lon) * (x - lon) + (y - lat) * (y - lat)) END) AS a, min(CASE WHEN c.region_id <> p.region_id THEN sqrt((x - lon) * (x - lon) + (y - lat) * (y - lat)) END) AS b FROM nc p JOIN ce c ON c.scene = p.scene GROUP BY 1, 2, 3, 4),
pe AS (SELECT scene, region_id, avg(a) AS s, sum(a * a) AS w, sum(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS sil FROM ds GROUP BY 1, 2), cc AS (SELECT * FROM ce JOIN pe USING (scene, region_id)),
mm AS (SELECT scene, sum(x * n) / sum(n) AS mx, sum(y * n) / sum(n) AS my, count(*) AS k, sum(n) AS total FROM ce GROUP BY 1),
dv AS (SELECT scene, avg(r) AS db FROM (SELECT a.scene, a.region_id, max((a.s + b.s) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS r FROM cc a JOIN cc b ON a.scene = b.scene AND a.region_id <> b.region_id GROUP BY 1, 2) GROUP BY 1)"""


@query("cluster_quality", f"WITH {QUALITY_SQL} SELECT cc.scene, round(any_value(db), 5) AS davies_bouldin, round((sum(n * ((x - mx) * (x - mx) + (y - my) * (y - my))) / (any_value(k) - 1)) / (sum(w) / (any_value(total) - any_value(k))), 3) AS calinski_harabasz, round(sum(sil) / any_value(total), 5) AS silhouette FROM cc JOIN mm USING (scene) JOIN dv USING (scene) GROUP BY cc.scene")
def _(t):
    q = cluster_quality(nearest_centroid(t.fx_p, t.fx_c), ["scene"], "region_id")
    return q.select("scene", F.round("davies_bouldin", 5).alias("davies_bouldin"), F.round("calinski_harabasz", 3).alias("calinski_harabasz"), F.round("silhouette", 5).alias("silhouette"))


def drift_mmd(source: DataFrame, target: DataFrame, id_col: str = "id") -> DataFrame:
    """RBF MMD^2 of two samples of at most 2,000 vectors each (v array<double>); the samples are the operator's bound. The kernel is exp(-d2 / m)
    with m the median positive squared distance within the source sample (1 where there is none)."""
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    met = lambda a, b: a.select(F.col(id_col).alias("i"), F.col("v").alias("x")).crossJoin(b.select(F.col(id_col).alias("j"), F.col("v").alias("y"))).select("i", "j", d2("x", "y").alias("d"))
    width = met(source, source).where("i < j AND d > 0").agg(F.coalesce(F.percentile("d", 0.5), F.lit(1.0)).alias("m"))
    mean = lambda a, b, name: met(a, b).crossJoin(F.broadcast(width)).agg(F.avg(F.exp(-F.col("d") / F.greatest("m", F.lit(1e-12)))).alias(name))  # noqa: E731  one row
    return mean(source, source, "ss").crossJoin(mean(target, target, "tt")).crossJoin(mean(source, target, "st")).select((F.col("ss") + F.col("tt") - 2 * F.col("st")).alias("mmd2"))


def hash_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows that come first in the order of md5(id): the sample of a bounded estimate."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)


_MMD = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 2 = {} ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 2000)"
_D2 = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
_RBF = f"(SELECT avg(exp(-{_D2} / m)) FROM {{}} a CROSS JOIN {{}} b CROSS JOIN w)"


@query("drift_mmd", f"WITH s AS {_MMD.format(0)}, g AS {_MMD.format(1)}, w AS (SELECT coalesce(median(d), 1) AS m FROM (SELECT {_D2} AS d FROM s a JOIN s b ON a.vec_id < b.vec_id) WHERE d > 0) SELECT round({_RBF.format('s', 's')} + {_RBF.format('g', 'g')} - 2 * {_RBF.format('s', 'g')}, 6) AS mmd2")
def _(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    halves = [hash_sample(e.where(F.col("id") % 2 == k), "id", 2_000) for k in (0, 1)]
    return drift_mmd(*halves).select(F.round("mmd2", 6).alias("mmd2"))
