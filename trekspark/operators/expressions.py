"""Projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.functions.geo import DEGREE_M, haversine_m, haversine_sql
from trekspark.graph import stored
from trekspark.plans.registry import query

# Classes of points of interest by the first two digits of their code.
POI_LEVEL1 = {"05": "餐饮", "08": "休闲", "10": "住宿", "11": "风景名胜", "14": "科教文化", "20": "公共设施"}
# Segment features and the columns that no feature group may hold.
FEATURES = ["dist_m", "up_m", "down_m", "mean_grade", "max_grade", "elev_mean", "start_ele", "tod_hour"]
FORBIDDEN = {"move_time_s", "n_pts", "dur_s", "naismith_s"}
_SLOPE, _ELEV = ["up_m", "down_m", "mean_grade", "max_grade"], ["elev_mean", "start_ele"]
FEATURE_GROUPS = {
    "full": FEATURES,
    "no_slope": [f for f in FEATURES if f not in _SLOPE],
    "no_elev": [f for f in FEATURES if f not in _ELEV],
    "no_updown": [f for f in FEATURES if f not in ("up_m", "down_m")],
    "slope_only": _SLOPE,
    "elev_only": _ELEV,
    "terrain_only": _SLOPE + _ELEV,
    "temporal_only": ["tod_hour"],
    "no_grade": [f for f in FEATURES if f not in ("mean_grade", "max_grade")],
    "no_dist": [f for f in FEATURES if f != "dist_m"],
    "dist_terrain": ["dist_m"] + _SLOPE + _ELEV,
    "updown_only": ["up_m", "down_m"],
}

def track_order():
    return Window.partitionBy("track_id").orderBy("t_s", "event_id")


def time_to_seconds(text: str) -> Column:
    """Seconds of the last token: H:M.S, M:S or a number; NULL for anything else."""
    token = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    part = lambda p, i: F.regexp_extract(token, p, i).try_cast("double")
    hms, ms = r"^(\d+):(\d+)\.(\d+)$", r"^(\d+):(\d+)$"
    return F.when(token.rlike(hms), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3)).when(token.rlike(ms), part(ms, 1) * 60 + part(ms, 2)).otherwise(token.try_cast("double"))


@query("time_to_seconds", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2014-03-15 ' || CAST(o_custkey % 24 AS VARCHAR) || ':' || CAST(o_orderkey % 60 AS VARCHAR) || '.' || CAST(o_custkey % 60 AS VARCHAR)
  WHEN 1 THEN CAST(o_custkey % 60 AS VARCHAR) || ':' || CAST(o_orderkey % 60 AS VARCHAR) WHEN 2 THEN 'x' WHEN 3 THEN CAST(o_custkey AS VARCHAR) || '.5' END AS s FROM orders),
u AS (SELECT o_orderkey, regexp_extract(s, '(\\S+)$', 1) AS k FROM t)
SELECT o_orderkey, CASE WHEN regexp_matches(k, '^\\d+:\\d+\\.\\d+$') THEN CAST(regexp_extract(k, '^(\\d+):', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(k, ':(\\d+)\\.', 1) AS DOUBLE) * 60 + CAST(regexp_extract(k, '\\.(\\d+)$', 1) AS DOUBLE)
  WHEN regexp_matches(k, '^\\d+:\\d+$') THEN CAST(regexp_extract(k, '^(\\d+):', 1) AS DOUBLE) * 60 + CAST(regexp_extract(k, ':(\\d+)$', 1) AS DOUBLE) ELSE TRY_CAST(k AS DOUBLE) END AS t_s FROM u""".replace("\\\\", "\\"))
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("2014-03-15 "), s(c % 24), F.lit(":"), s(k % 60), F.lit("."), s(c % 60))).when(k % 5 == 1, F.concat(s(c % 60), F.lit(":"), s(k % 60))).when(k % 5 == 2, "x").when(k % 5 == 3, F.concat(s(c), F.lit(".5")))
    return t.orders.select("o_orderkey", text.alias("s")).select("o_orderkey", time_to_seconds("s").alias("t_s"))


def epoch_seconds(df: DataFrame, track: str = "track_id", time: str = "t_s") -> DataFrame:
    """Tracks whose largest time exceeds 1e10 are in milliseconds and divided by 1000."""
    return df.withColumn(time, F.when(F.max(time).over(Window.partitionBy(track)) > 1e10, F.col(time) / 1000).otherwise(F.col(time)))


@query("epoch_seconds", "WITH m AS (SELECT track_id, event_id, CASE WHEN track_id % 2 = 0 THEN (17e8 + t_s) * 1e3 ELSE 17e8 + t_s END AS t_s FROM fx_p) SELECT track_id, event_id, CASE WHEN max(t_s) OVER (PARTITION BY track_id) > 1e10 THEN t_s / 1000 ELSE t_s END AS t_s FROM m")
def _(t):
    raw = t.fx_p.select("track_id", "event_id", F.when(F.col("track_id") % 2 == 0, (F.col("t_s") + 17e8) * 1e3).otherwise(F.col("t_s") + 17e8).alias("t_s"))
    return epoch_seconds(raw)


def hop_metres(df: DataFrame) -> DataFrame:
    """hop_m: metres from the track's previous point; NULL at its first."""
    return df.withColumn("hop_m", haversine_m(F.lag("lon").over(track_order()), F.lag("lat").over(track_order()), F.col("lon"), F.col("lat")))


HOPS_SQL = f"SELECT *, {haversine_sql('lag(lon) OVER o', 'lag(lat) OVER o', 'lon', 'lat')} AS hop_m, t_s - lag(t_s) OVER o AS dt_s FROM fx_p WINDOW o AS (PARTITION BY track_id ORDER BY t_s, event_id)"


@query("haversine_m", f"SELECT track_id, event_id, round(hop_m, 3) AS hop_m FROM ({HOPS_SQL})")
def _(t):
    return hop_metres(t.fx_p).select("track_id", "event_id", F.round("hop_m", 3).alias("hop_m"))


def local_metres(df: DataFrame, train: Column) -> DataFrame:
    """x_m and y_m: equirectangular metres by scene, the mean latitude taken over train rows."""
    mean = df.where(train).groupBy("scene").agg(F.avg("lat").alias("_lat"))
    return df.join(mean, "scene").select(df["*"], (F.col("lon") * F.cos(F.radians("_lat")) * DEGREE_M).alias("x_m"), (F.col("lat") * DEGREE_M).alias("y_m"))


@query("local_metres", "WITH m AS (SELECT scene, avg(lat) AS mlat FROM fx_p WHERE track_id % 10 < 7 GROUP BY scene) SELECT track_id, event_id, round(lon * cos(radians(mlat)) * 111320, 3) AS x_m, round(lat * 111320, 3) AS y_m, ele FROM fx_p JOIN m USING (scene)")
def _(t):
    return local_metres(t.fx_p, F.col("track_id") % 10 < 7).select("track_id", "event_id", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"), "ele")


def minmax_scale(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """Scale to [0, 1] by the train rows' range; others may fall outside, and a constant gives 0."""
    fit = df.where(train).agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = [F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]
    return df.join(F.broadcast(fit)).select(*(c for c in df.columns if c not in cols), *scaled)  # fit is one row


@query("minmax_scale", "WITH m AS (SELECT min(lon) a, max(lon) b, min(lat) c, max(lat) d FROM fx_p WHERE track_id % 10 < 7) SELECT track_id, event_id, round((lon - a) / (b - a), 6) AS lon, round((lat - c) / (d - c), 6) AS lat FROM fx_p, m")
def _(t):
    return minmax_scale(t.fx_p.select("track_id", "event_id", "lon", "lat"), ["lon", "lat"], F.col("track_id") % 10 < 7).select("track_id", "event_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def standard_scale(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """z-scores with the train rows' mean and population deviation (+ 1e-6)."""
    fit = df.where(train).agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return df.join(F.broadcast(fit)).select(*(c for c in df.columns if c not in cols), *(((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)).alias(c) for c in cols))


@query("standard_scale", "WITH m AS (SELECT avg(up_m) a, stddev_pop(up_m) b, avg(dist_m) c, stddev_pop(dist_m) d FROM fx_s WHERE track % 10 < 7) SELECT track, seg_idx, round((up_m - a) / (b + 1e-6), 5) AS up_m, round((dist_m - c) / (d + 1e-6), 5) AS dist_m FROM fx_s, m")
def _(t):
    return standard_scale(t.fx_s.select("track", "seg_idx", "up_m", "dist_m"), ["up_m", "dist_m"], F.col("track") % 10 < 7).select("track", "seg_idx", F.round("up_m", 5).alias("up_m"), F.round("dist_m", 5).alias("dist_m"))


def point_speed(df: DataFrame) -> DataFrame:
    """speed: km/h from the previous point; 0 at the first point and where time does not advance."""
    dt = F.col("t_s") - F.lag("t_s").over(track_order())
    return hop_metres(df).withColumn("speed", F.when(dt > 0, F.col("hop_m") / dt * 3.6).otherwise(0.0))


@query("point_speed_kmh", f"SELECT track_id, event_id, round(CASE WHEN dt_s > 0 THEN hop_m / dt_s * 3.6e0 ELSE 0e0 END, 4) AS speed FROM ({HOPS_SQL})")
def _(t):
    return point_speed(t.fx_p).select("track_id", "event_id", F.round("speed", 4).alias("speed"))


def hour_of_day(time: str) -> Column:
    return F.pmod(F.col(time), F.lit(86400.0)) / 3600


@query("time_of_day_features", "WITH h AS (SELECT track_id, event_id, ((t_s * 37) % 86400) / 3600e0 AS h FROM fx_p) SELECT track_id, event_id, round(h, 6) AS tod_hour, round(sin(h / 24e0 * 2 * pi()), 6) AS tod_sin, round(cos(h / 24e0 * 2 * pi()), 6) AS tod_cos, CAST(floor(h / 4e0) AS INT) AS bin4, CASE WHEN h < 6 THEN 0 WHEN h < 9 THEN 1 WHEN h < 12 THEN 2 WHEN h < 15 THEN 3 WHEN h < 18 THEN 4 ELSE 5 END AS report_bin FROM h")
def _(t):
    h = t.fx_p.select("track_id", "event_id", (F.col("t_s") * 37).alias("t")).select("track_id", "event_id", hour_of_day("t").alias("h"))
    angle = F.col("h") / 24 * 2 * F.pi()
    return h.select("track_id", "event_id", F.round("h", 6).alias("tod_hour"), F.round(F.sin(angle), 6).alias("tod_sin"), F.round(F.cos(angle), 6).alias("tod_cos"), F.floor(F.col("h") / 4).cast("int").alias("bin4"), report_bin("h").alias("report_bin"))


def report_bin(hour: str) -> Column:
    """Bins with edges 0, 6, 9, 12, 15, 18, 24."""
    out = F.when(F.col(hour) < 6, 0)
    for k, edge in enumerate((9, 12, 15, 18), 1):
        out = out.when(F.col(hour) < edge, k)
    return out.otherwise(5)


def naismith_seconds(metres: str, climb: str) -> Column:
    return (F.col(metres) / 1000 / 5 + F.col(climb) / 600) * 3600


@query("naismith_seconds", "SELECT track, seg_idx, round((dist_m / 1000 / 5 + up_m / 600) * 3600 + 1e-6, 3) AS walk_s FROM fx_s")
def _(t):
    return t.fx_s.select("track", "seg_idx", F.round(naismith_seconds("dist_m", "up_m") + 1e-6, 3).alias("walk_s"))


def poi_level1(code: str) -> Column:
    """Class name by the code's first two digits; other codes stay as they are."""
    names = F.create_map(*(F.lit(x) for pair in POI_LEVEL1.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.substring(code, 1, 2)), F.substring(code, 1, 2))


@query("poi_level1", "SELECT poi_id, CASE substr(type_code, 1, 2) WHEN '05' THEN '餐饮' WHEN '08' THEN '休闲' WHEN '10' THEN '住宿' WHEN '11' THEN '风景名胜' WHEN '14' THEN '科教文化' WHEN '20' THEN '公共设施' ELSE substr(type_code, 1, 2) END AS level1 FROM fx_poi")
def _(t):
    return t.fx_poi.select("poi_id", poi_level1("type_code").alias("level1"))


def region_label(share: str) -> Column:
    """Label by the dominant class's percent: over 60 core, over 40 mainly, over 25 mixed, else general."""
    s = F.col(share)
    return F.when(s > 60, "core").when(s > 40, "mainly").when(s > 25, "mixed").otherwise("general")


@query("region_semantic_label", "WITH c AS (SELECT scene, substr(type_code, 1, 2) AS k, count(*) AS n FROM fx_poi WHERE poi_id % 3 < 2 GROUP BY 1, 2), s AS (SELECT scene, round(100e0 * max(n) / sum(n), 4) AS share FROM c GROUP BY scene) SELECT scene, share, CASE WHEN share > 60 THEN 'core' WHEN share > 40 THEN 'mainly' WHEN share > 25 THEN 'mixed' ELSE 'general' END AS label FROM s")
def _(t):
    c = t.fx_poi.where("poi_id % 3 < 2").groupBy("scene", F.substring("type_code", 1, 2).alias("k")).count()
    return c.groupBy("scene").agg(F.round(F.max("count") * 100.0 / F.sum("count"), 4).alias("share")).withColumn("label", region_label("share"))


def route_type(seq: str, start_lat: str, end_lat: str) -> Column:
    """Two regions or fewer: short; same first and last: loop; else by direction of latitude."""
    s = F.col(seq)
    return F.when(F.size(s) <= 2, "short").when(F.element_at(s, 1) == F.element_at(s, -1), "loop").when(F.col(end_lat) > F.col(start_lat), "north").otherwise("south")


def clean_numeric(c: str) -> Column:
    """NaN and infinities become 0."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clean_label(c: str, most: float = 7200.0) -> Column:
    """NaN and -inf become 0, the rest is clipped to [0, most]."""
    x = F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c))
    return F.greatest(F.lit(0.0), F.least(F.lit(most), x))


@query("clean_numeric", "SELECT track, seg_idx, CASE WHEN seg_idx = 1 THEN 0e0 ELSE mean_grade END AS mean_grade, greatest(0e0, least(7200e0, CASE WHEN seg_idx = 2 THEN 7200e0 ELSE dur_s * 10 - 5e3 END)) AS dur_s FROM fx_s")
def _(t):
    dirty = t.fx_s.select("track", "seg_idx", F.when(F.col("seg_idx") == 1, float("nan")).otherwise(F.col("mean_grade")).alias("mean_grade"), F.when(F.col("seg_idx") == 2, float("inf")).otherwise(F.col("dur_s") * 10 - 5e3).alias("dur_s"))
    return dirty.select("track", "seg_idx", clean_numeric("mean_grade").alias("mean_grade"), clean_label("dur_s").alias("dur_s"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels: list[float], between: bool, accuracy: int = 20_000) -> DataFrame:
    """(keys, q): the exact quantiles of each key's values at ``levels``, whatever their number. ``between``: interpolated between
    neighbours (quantile_cont), else the first value that at least that share of the rows reaches (quantile_disc). Nulls do not count.

    A sketch of fixed size brackets each level; rows below a bracket are counted, those in it (a thousandth of all) are ordered, and
    the value of the rank is picked. So no task holds or sorts all values.
    """
    rows = stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    ends = [x for p in levels for x in (max(p - 10 / accuracy, 0.0), min(p + 10 / accuracy, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"), F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    at = lambda p: F.lit(p) * (F.col("_n") - 1) if between else F.greatest(F.col("_n") - F.floor(F.col("_n") - F.col("_n") * F.lit(p)) - 1, F.lit(0))
    # few rows are all taken; a bracket at the edge of all ranks takes the rest
    low = lambda k: F.when((F.col("_n") <= accuracy) | (F.floor(at(levels[k])) <= F.col("_n") * (20 / accuracy)), F.col("_min")).otherwise(F.col("_e")[2 * k])
    high = lambda k: F.when((F.col("_n") <= accuracy) | (F.floor(at(levels[k])) + 1 >= F.col("_n") * (1 - 20 / accuracy)), F.col("_max")).otherwise(F.col("_e")[2 * k + 1])
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), low(k).alias("low"), high(k).alias("high"), at(p).cast("double").alias("at")) for k, p in enumerate(levels)))
    brackets = F.broadcast(sketch.select(*keys, wanted.alias("_w")))  # a row a key
    met = rows.join(brackets, keys) if keys else rows.crossJoin(brackets)
    parts = met.groupBy(*keys).agg(*(F.count(F.when(F.col("_v") < F.col("_w")[k]["low"], 1)).alias(f"_b{k}") for k in range(len(levels))))
    inside = met.select(*keys, "_v", F.explode(F.filter("_w", lambda w: (F.col("_v") >= w["low"]) & (F.col("_v") <= w["high"]))).alias("w")).select(*keys, "_v", "w.k", "w.at")
    inside = inside.groupBy(*keys, "k", "at", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "k").orderBy("_v"))
    below = F.array(*(F.col(f"_b{k}") for k in range(len(levels))))
    counts = parts.select(*keys, below.alias("_below"))
    ranked = inside.withColumn("_to", upto)
    ranked = (ranked.join(F.broadcast(counts), keys) if keys else ranked.crossJoin(F.broadcast(counts))).withColumn("_to", F.col("_to") + F.get("_below", F.col("k")))
    holds = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_c") <= r)
    first, second, part = F.floor("at"), F.ceil("at"), F.col("at") - F.floor("at")
    picked = ranked.groupBy(*keys, "k").agg(F.max(F.when(holds(first), F.col("_v"))).alias("a"), F.max(F.when(holds(second), F.col("_v"))).alias("b"), F.first(part).alias("p"))
    each = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("p")) + F.col("b") * F.col("p"))
    listed = F.collect_list(F.struct("k", each.alias("v")))
    return picked.groupBy(*keys).agg(F.when(F.size(listed) > 0, F.transform(F.sort_array(listed), lambda x: x["v"])).alias("q"))


def interval_buckets(df: DataFrame, value: str, train: Column, buckets: int = 8) -> DataFrame:
    """bucket: number of the train rows' inner quantile edges that are at most the value."""
    edges = exact_quantiles(df.where(train), [], value, [k / buckets for k in range(1, buckets)], True)
    return df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("q", lambda e: e <= F.col(value)))).drop("q")  # one row


@query("interval_buckets", "WITH e AS (SELECT quantile_cont(dur_s, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM fx_s WHERE track % 10 < 7) SELECT track, seg_idx, CAST(len(list_filter(q, lambda x: x <= dur_s)) AS INT) AS bucket FROM fx_s, e")
def _(t):
    return interval_buckets(t.fx_s.select("track", "seg_idx", "dur_s"), "dur_s", F.col("track") % 10 < 7).select("track", "seg_idx", "bucket")


@query("global_track_key", "SELECT DISTINCT CAST(scene AS VARCHAR) || '|' || CAST(track AS VARCHAR) AS gtrack FROM fx_s")
def _(t):
    return t.fx_s.select(F.concat_ws("|", "scene", "track").alias("gtrack")).distinct()


def normal_cdf(z: Column) -> Column:
    """The normal distribution by formula 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / (2**0.5)
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.sqrt(2 * F.pi())


def normal_cdf_sql(z: str) -> str:
    x, k = f"(abs({z}) / sqrt(2e0))", f"(1e0 / (1e0 + 0.3275911e0 * abs({z}) / sqrt(2e0)))"
    erf = f"(1e0 - {k} * (0.254829592e0 + {k} * (-0.284496736e0 + {k} * (1.421413741e0 + {k} * (-1.453152027e0 + {k} * 1.061405429e0)))) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1e0 + {erf}) / 2e0 ELSE (1e0 - {erf}) / 2e0 END)"


@query("normal_cdf_pdf", f"WITH z AS (SELECT track_id, pos, (true_dur - mu) / sigma AS z FROM fx_pred) SELECT track_id, pos, round({normal_cdf_sql('z')}, 5) AS cdf, round(exp(-z * z / 2) / sqrt(2 * pi()), 5) AS pdf FROM z")
def _(t):
    z = (F.col("true_dur") - F.col("mu")) / F.col("sigma")
    return t.fx_pred.select("track_id", "pos", F.round(normal_cdf(z), 5).alias("cdf"), F.round(normal_pdf(z), 5).alias("pdf"))


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("n.s.")


@query("significance_stars", "WITH p AS (SELECT target, seed, grp, (n_seg % 97) / 1e3 AS p FROM fx_res) SELECT target, seed, grp, CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 5e-2 THEN '*' ELSE 'n.s.' END AS stars FROM p")
def _(t):
    return t.fx_res.withColumn("p", F.col("n_seg") % 97 / 1e3).select("target", "seed", "grp", stars("p").alias("stars"))


CLASSES = ["05", "06", "08", "10", "11", "14", "17", "20"]


def share_map(poi: DataFrame, keys: list[str]) -> DataFrame:
    """profile: map from class to its share of the key's points of interest, to 4 decimals."""
    n = poi.groupBy(*keys, F.substring("type_code", 1, 2).alias("cls")).count()
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy(*keys)), 4)
    return n.withColumn("share", share).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "share")))).alias("profile"))


def map_vector(profile: str, names: list[str] = CLASSES) -> Column:
    """The map's values in the order of ``names``, 0 where missing."""
    return F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.coalesce(F.try_element_at(F.col(profile), n), F.lit(0.0)))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors; 0 if either is empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(F.col(a), F.col(b)) / F.nullif(F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))), F.lit(0.0)), F.lit(0.0))


SHARES_SQL = "n AS (SELECT scene, substr(type_code, 1, 2) AS cls, count(*) AS n FROM fx_poi WHERE (poi_id * 31) % 11 < scene + 5 GROUP BY 1, 2), sh AS (SELECT scene, cls, round(n / sum(n) OVER (PARTITION BY scene), 4) AS share FROM n)"


@query("poi_vector", f"WITH {SHARES_SQL}, k AS (SELECT unnest(['05','06','08','10','11','14','17','20']) AS cls, unnest(range(8)) AS i), s AS (SELECT DISTINCT scene FROM sh) SELECT s.scene, CAST(k.i AS INT) AS i, coalesce(sh.share, 0e0) AS share FROM s CROSS JOIN k LEFT JOIN sh ON sh.scene = s.scene AND sh.cls = k.cls")
def _(t):
    p = share_map(t.fx_poi.where("(poi_id * 31) % 11 < scene + 5"), ["scene"])
    return p.select("scene", F.posexplode(map_vector("profile")).alias("i", "share"))


@query("poi_cosine", f"WITH {SHARES_SQL} SELECT a.scene AS a, b.scene AS b, round(sum(a.share * b.share) / (sqrt(max(x.r)) * sqrt(max(y.r))), 6) AS cosine FROM sh a JOIN sh b ON a.cls = b.cls AND a.scene < b.scene JOIN (SELECT scene, sum(share * share) AS r FROM sh GROUP BY scene) x ON x.scene = a.scene JOIN (SELECT scene, sum(share * share) AS r FROM sh GROUP BY scene) y ON y.scene = b.scene GROUP BY 1, 2")
def _(t):
    v = share_map(t.fx_poi.where("(poi_id * 31) % 11 < scene + 5"), ["scene"]).select("scene", map_vector("profile").alias("v"))
    a, b = v.select(F.col("scene").alias("a"), F.col("v").alias("x")), v.select(F.col("scene").alias("b"), F.col("v").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine("x", "y"), 6).alias("cosine"))  # four scenes


def reachable(scores: DataFrame, transitions: DataFrame) -> DataFrame:
    """Only candidate moves (region_id, nxt) that train transitions hold."""
    return scores.join(transitions.select("region_id", "nxt").distinct(), ["region_id", "nxt"], "left_semi")


STEPS_SQL = "st AS (SELECT *, lead(region_id) OVER o AS nxt, lead(t_s) OVER o - t_s AS dur, CAST(row_number() OVER o AS INT) AS pos FROM fx_r WINDOW o AS (PARTITION BY track_id ORDER BY t_s, event_id))"


def steps(visits: DataFrame) -> DataFrame:
    """Visits with the next region (nxt), the time to it (dur) and their position (from 1)."""
    return visits.withColumns({"nxt": F.lead("region_id").over(track_order()), "dur": F.lead("t_s").over(track_order()) - F.col("t_s"), "pos": F.row_number().over(track_order())})


@query("reachable_mask", f"WITH {STEPS_SQL} SELECT track_id, event_id, region_id, nxt FROM st SEMI JOIN (SELECT DISTINCT region_id, nxt FROM st WHERE track_id % 10 < 7 AND nxt IS NOT NULL) mv USING (region_id, nxt) WHERE track_id % 10 >= 7")
def _(t):
    s = steps(t.fx_r)
    return reachable(s.where("track_id % 10 >= 7").select("track_id", "event_id", "region_id", "nxt"), s.where("track_id % 10 < 7 and nxt is not null")).select("track_id", "event_id", "region_id", "nxt")


def feature_group(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys and the features of a named group; label and time columns are refused."""
    cols = FEATURE_GROUPS[name]
    if FORBIDDEN & {*cols, *keys}:
        raise ValueError(f"feature group {name} holds a label column")
    return df.select(*keys, *cols)


@query("feature_group_select", "SELECT track, seg_idx, dist_m, elev_mean, start_ele, tod_hour FROM fx_s")
def _(t):
    return feature_group(t.fx_s, "no_slope", ["track", "seg_idx"])
