"""Aggregates, splits, count-based forecasts, scores and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.operators.expressions import STEPS_SQL, normal_cdf, normal_cdf_sql, normal_pdf, report_bin, steps
from trekspark.plans.registry import query


def region_means(visits: DataFrame) -> DataFrame:
    """(region_id, mean_dur, n): mean time to the next region, by region."""
    return steps(visits).where("nxt is not null").groupBy("region_id").agg(F.avg("dur").alias("mean_dur"), F.count("*").alias("n"))


@query("duration_by_region", f"WITH {STEPS_SQL} SELECT region_id, round(avg(dur), 4) AS mean_dur, count(*) AS n FROM st WHERE nxt IS NOT NULL GROUP BY region_id")
def _(t):
    return region_means(t.fx_r).withColumn("mean_dur", F.round("mean_dur", 4))


def pair_prior(train: DataFrame) -> DataFrame:
    """(region_id, nxt, mu, sigma, n) of the time between two regions, from train steps."""
    return train.where("nxt is not null").groupBy("region_id", "nxt").agg(F.avg("dur").alias("mu"), F.stddev_samp("dur").alias("sigma"), F.count("*").alias("n"))


@query("pair_prior", f"WITH {STEPS_SQL} SELECT region_id, nxt, round(avg(dur), 4) AS mu, round(stddev_samp(dur), 4) AS sigma, count(*) AS n FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1, 2")
def _(t):
    return pair_prior(steps(t.fx_r).where("track_id % 10 < 7")).withColumns({"mu": F.round("mu", 4), "sigma": F.round("sigma", 4)})


def prior_lookup(test: DataFrame, prior: DataFrame) -> DataFrame:
    """Test steps with mu: the pair's train mean, or the mean over all train steps where the pair is new."""
    overall = prior.agg((F.sum(F.col("mu") * F.col("n")) / F.sum("n")).alias("_all"))
    return test.join(prior.select("region_id", "nxt", "mu"), ["region_id", "nxt"], "left").join(F.broadcast(overall)).withColumn("mu", F.coalesce("mu", "_all")).drop("_all")  # overall is one row


@query("prior_lookup", f"WITH {STEPS_SQL}, p AS (SELECT region_id, nxt, avg(dur) AS mu FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1, 2), g AS (SELECT avg(dur) AS g FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7) SELECT s.track_id, s.pos, round(coalesce(p.mu, g), 3) AS mu FROM st s LEFT JOIN p ON p.region_id = s.region_id AND p.nxt = s.nxt CROSS JOIN g WHERE s.nxt IS NOT NULL AND s.track_id % 10 >= 7")
def _(t):
    s = steps(t.fx_r).where("nxt is not null")
    return prior_lookup(s.where("track_id % 10 >= 7"), pair_prior(s.where("track_id % 10 < 7"))).select("track_id", "pos", F.round("mu", 3).alias("mu"))


@query("region_median", f"WITH {STEPS_SQL} SELECT region_id, round(median(dur), 4) AS median_dur FROM st WHERE nxt IS NOT NULL GROUP BY region_id")
def _(t):
    return steps(t.fx_r).where("nxt is not null").groupBy("region_id").agg(F.round(F.percentile("dur", 0.5), 4).alias("median_dur"))


@query("route_position_stats", f"WITH {STEPS_SQL} SELECT route_id, pos, round(quantile_cont(dur, 0.25), 4) AS p25, round(quantile_cont(dur, 0.5), 4) AS p50, round(quantile_cont(dur, 0.75), 4) AS p75, round(avg(dur), 4) AS mean_dur, count(*) AS n FROM st WHERE nxt IS NOT NULL GROUP BY 1, 2")
def _(t):
    q = F.percentile("dur", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = steps(t.fx_r).where("nxt is not null").groupBy("route_id", "pos").agg(q.alias("q"), F.round(F.avg("dur"), 4).alias("mean_dur"), F.count("*").alias("n"))
    return a.select("route_id", "pos", *(F.round(F.col("q")[k], 4).alias(c) for k, c in enumerate(("p25", "p50", "p75"))), "mean_dur", "n")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent ``value`` of each key with its count; ties to the smaller value."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("_v"))).alias("_b")).select(*keys, F.col("_b._v").alias(value), (-F.col("_b._n")).alias("n"))


def route_templates(rows: DataFrame) -> DataFrame:
    """(route_id, pos, region_id, n, mean_dur, tracks): each route's most common region at each position (ties to the smaller), the mean time to
    the next of all its tracks there (0 where none goes on), and how many tracks the route has."""
    best = most_frequent(rows, ["route_id", "pos"], "region_id")
    mean = rows.groupBy("route_id", "pos").agg(F.coalesce(F.avg("dur"), F.lit(0.0)).alias("mean_dur"))
    size = rows.groupBy("route_id").agg(F.countDistinct("track_id").alias("tracks"))
    return best.join(mean, ["route_id", "pos"]).join(size, "route_id")


@query("route_templates", f"WITH {STEPS_SQL}, n AS (SELECT route_id, pos, region_id, count(*) AS n FROM st GROUP BY 1, 2, 3), d AS (SELECT route_id, pos, coalesce(avg(dur), 0) AS mean_dur FROM st GROUP BY 1, 2), z AS (SELECT route_id, count(DISTINCT track_id) AS tracks FROM st GROUP BY 1) SELECT route_id, pos, region_id, n, round(mean_dur, 4) AS mean_dur, tracks FROM (SELECT *, row_number() OVER (PARTITION BY route_id, pos ORDER BY n DESC, region_id) AS k FROM n) JOIN d USING (route_id, pos) JOIN z USING (route_id) WHERE k = 1")
def _(t):
    return route_templates(steps(t.fx_r)).withColumn("mean_dur", F.round("mean_dur", 4))


MARKOV_SQL = f"{STEPS_SQL}, mn AS (SELECT region_id, nxt, count(*) AS n FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1, 2), mk AS (SELECT region_id, nxt AS pred FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, nxt) AS k FROM mn) WHERE k = 1), gb AS (SELECT nxt AS best FROM (SELECT nxt, sum(n) AS n FROM mn GROUP BY nxt) ORDER BY n DESC, nxt LIMIT 1)"


def markov_next(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test steps with pred: the most frequent successor in train, or the most frequent overall for a new region."""
    moves = train.where("nxt is not null")
    best = most_frequent(moves, ["region_id"], "nxt").select("region_id", F.col("nxt").alias("pred"))
    overall = most_frequent(moves.withColumn("_g", F.lit(1)), ["_g"], "nxt").select(F.col("nxt").alias("_best"))
    return test.join(best, "region_id", "left").join(F.broadcast(overall), how="left").withColumn("pred", F.coalesce("pred", "_best")).drop("_best")


@query("markov_next", f"WITH {MARKOV_SQL} SELECT track_id, pos, nxt, coalesce(pred, best) AS pred FROM st LEFT JOIN mk USING (region_id) CROSS JOIN gb WHERE nxt IS NOT NULL AND track_id % 10 >= 7")
def _(t):
    s = steps(t.fx_r)
    return markov_next(s.where("nxt is not null and track_id % 10 >= 7"), s.where("track_id % 10 < 7")).select("track_id", "pos", "nxt", "pred")


@query("duration_by_region_predict", f"WITH {STEPS_SQL}, m AS (SELECT region_id, avg(dur) AS mu FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1) SELECT track_id, pos, round(abs(dur - mu), 3) AS err FROM st JOIN m USING (region_id) WHERE nxt IS NOT NULL AND track_id % 10 >= 7")
def _(t):
    s = steps(t.fx_r).where("nxt is not null")
    mu = s.where("track_id % 10 < 7").groupBy("region_id").agg(F.avg("dur").alias("mu"))
    return s.where("track_id % 10 >= 7").join(mu, "region_id").select("track_id", "pos", F.round(F.abs(F.col("dur") - F.col("mu")), 3).alias("err"))


def hash_rank(df: DataFrame, keys: list[str], seed: int, within: tuple = ()) -> DataFrame:
    """``df`` with _k, the row's place (from 1) in the order of md5(seed | keys), then the keys, and _n, the number
    of rows, of each ``within``. Rows are counted by the first four hex digits and ranked inside those
    runs, so no task sorts all rows."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    marked = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 4))
    w = Window.partitionBy(*within)
    runs = marked.groupBy(*within, "_p").agg(F.count("*").alias("_c"))
    runs = runs.select(*within, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*within, "_p").orderBy("_h", *keys))
    return marked.withColumn("_k", inside).join(runs, [*within, "_p"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_h", "_p", "_before")


def split_tracks(df: DataFrame, track: str, ratio: float = 0.7, seed: int = 42, within: tuple = ()) -> DataFrame:
    """``df`` with train: whole tracks, floor(n * ratio) of them (of each ``within``) in the order of
    md5(seed | track). The order is taken over one row per track."""
    picked = hash_rank(df.select(track, *within).distinct(), [track], seed, within).select(track, *within, (F.col("_k") <= F.floor(F.col("_n") * ratio)).alias("train"))
    return df.join(picked, [track, *within])


@query("split_tracks", "WITH k AS (SELECT track_id, row_number() OVER (ORDER BY md5('42|' || CAST(track_id AS VARCHAR)), track_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT track_id FROM fx_r)) SELECT track_id, event_id, k <= floor(n * 0.7) AS train FROM fx_r JOIN k USING (track_id)")
def _(t):
    return split_tracks(t.fx_r, "track_id").select("track_id", "event_id", "train")


@query("leave_one_scene_out", "WITH k AS (SELECT scene, track, row_number() OVER (PARTITION BY scene ORDER BY md5('42|' || CAST(track AS VARCHAR)), track) AS k, count(*) OVER (PARTITION BY scene) AS n FROM (SELECT DISTINCT scene, track FROM fx_s)), s AS (SELECT scene, track, k <= floor(n * 0.8) AS train FROM k) SELECT s.train, fx_s.scene = 3 AS target, count(*) AS n FROM fx_s JOIN s ON s.scene = fx_s.scene AND s.track = fx_s.track WHERE (fx_s.scene <> 3 AND s.train) OR (fx_s.scene = 3 AND NOT s.train) GROUP BY 1, 2")
def _(t):
    return leave_one_scene_out(t.fx_s, 3).groupBy("train", "target").agg(F.count("*").alias("n"))


def leave_one_scene_out(segments: DataFrame, target: int) -> DataFrame:
    """The other scenes' train rows and the target scene's test rows (target true)."""
    s = split_tracks(segments, "track", 0.8, within=("scene",)).withColumn("target", F.col("scene") == target)
    return s.where("(not target and train) or (target and not train)")


def fewshot_tracks(df: DataFrame, track: str, within: tuple, ratios: tuple = (0.05, 0.1, 0.25), rep: int = 1) -> DataFrame:
    """(within, ratio, track): for each ratio so many whole tracks of each target, at least one, in the order of md5(1000 + rep | track); a
    larger ratio holds the smaller ones."""
    ranked = hash_rank(df.select(*within, track).distinct(), [track], 1000 + rep, within)
    each = ranked.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in ratios))))
    return each.where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("ratio")))).select(*within, "ratio", track)


@query("fewshot_tracks", "SELECT scene, ratio, track FROM (SELECT scene, track, row_number() OVER (PARTITION BY scene ORDER BY md5('1001|' || CAST(track AS VARCHAR)), track) AS k, count(*) OVER (PARTITION BY scene) AS n FROM (SELECT DISTINCT scene, track FROM fx_s)) CROSS JOIN (VALUES (5e-2), (1e-1), (25e-2)) AS v(ratio) WHERE k <= greatest(1, floor(n * ratio))")
def _(t):
    return fewshot_tracks(t.fx_s, "track", ("scene",))


@query("topk_accuracy", "SELECT pos, round(avg(CASE WHEN pred_next = true_next THEN 1e0 ELSE 0e0 END), 6) AS top1, count(*) AS n FROM fx_pred GROUP BY pos")
def _(t):
    return t.fx_pred.groupBy("pos").agg(F.round(F.avg((F.col("pred_next") == F.col("true_next")).cast("double")), 6).alias("top1"), F.count("*").alias("n"))


def class_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(label, tp, n_true, n_pred, f1) of every label that is true or predicted somewhere; one aggregation."""
    both = df.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    return both.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred")).withColumn("f1", 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred")))


@query("macro_f1", "WITH l AS (SELECT true_next AS label FROM fx_pred UNION SELECT pred_next FROM fx_pred), s AS (SELECT label, (SELECT count(*) FROM fx_pred WHERE true_next = label AND pred_next = label) AS tp, (SELECT count(*) FROM fx_pred WHERE true_next = label) AS a, (SELECT count(*) FROM fx_pred WHERE pred_next = label) AS b FROM l) SELECT label, tp, round(2e0 * tp / (a + b), 6) AS f1 FROM s")
def _(t):
    return class_scores(t.fx_pred, "true_next", "pred_next").select("label", "tp", F.round("f1", 6).alias("f1"))


@query("duration_errors", "SELECT scene, round(avg(abs(mu - true_dur)) / 60, 4) AS mae_min, round(avg(abs(mu - true_dur) / nullif(true_dur, 0)), 4) AS mape, count(*) AS n FROM fx_pred GROUP BY scene")
def _(t):
    e = F.abs(F.col("mu") - F.col("true_dur"))
    return t.fx_pred.groupBy("scene").agg(F.round(F.avg(e) / 60, 4).alias("mae_min"), F.round(F.avg(e / F.nullif(F.col("true_dur"), F.lit(0.0))), 4).alias("mape"), F.count("*").alias("n"))


@query("arrival_errors", "WITH c AS (SELECT track_id, pos, sum(mu - true_dur) OVER (PARTITION BY track_id ORDER BY pos) AS e FROM fx_pred) SELECT pos, round(avg(abs(e)), 2) AS mae, round(avg(CASE WHEN abs(e) <= 1800 THEN 1e0 ELSE 0e0 END), 6) AS within30 FROM c GROUP BY pos")
def _(t):
    e = F.abs(F.sum(F.col("mu") - F.col("true_dur")).over(Window.partitionBy("track_id").orderBy("pos")))
    return t.fx_pred.withColumn("e", e).groupBy("pos").agg(F.round(F.avg("e"), 2).alias("mae"), F.round(F.avg((F.col("e") <= 1800).cast("double")), 6).alias("within30"))


def coverage(z: Column, sigma: Column) -> dict[str, Column]:
    """PICP90, mean width and Gaussian CRPS of scaled errors."""
    crps = sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / F.sqrt(F.pi()))
    return {"picp90": F.avg((F.abs(z) <= 1.6449).cast("double")), "width": F.avg(2 * 1.6449 * sigma), "crps": F.avg(crps)}


@query("coverage_scores", f"WITH z AS (SELECT scene, sigma, (true_dur - mu) / sigma AS z FROM fx_pred) SELECT scene, round(avg(CASE WHEN abs(z) <= 1.6449e0 THEN 1e0 ELSE 0e0 END), 4) AS picp90, round(avg(2 * 1.6449e0 * sigma), 1) AS width, round(avg(sigma * (z * (2 * {normal_cdf_sql('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 1) AS crps FROM z GROUP BY scene")
def _(t):
    scores = coverage((F.col("true_dur") - F.col("mu")) / F.col("sigma"), F.col("sigma"))
    return t.fx_pred.groupBy("scene").agg(F.round(scores["picp90"], 4).alias("picp90"), F.round(scores["width"], 1).alias("width"), F.round(scores["crps"], 1).alias("crps"))


@query("calibrate_sigma", "SELECT scene, round(quantile_cont(abs((true_dur - mu) / sigma), 0.9) / 1.6449e0, 5) AS factor FROM fx_pred GROUP BY scene HAVING count(*) >= 10")
def _(t):
    z = F.abs((F.col("true_dur") - F.col("mu")) / F.col("sigma"))
    return t.fx_pred.groupBy("scene").agg(F.round(F.percentile(z, 0.9) / 1.6449, 5).alias("factor"), F.count("*").alias("n")).where("n >= 10").drop("n")


@query("tod_errors", "SELECT CASE WHEN tod_hour < 6 THEN 0 WHEN tod_hour < 9 THEN 1 WHEN tod_hour < 12 THEN 2 WHEN tod_hour < 15 THEN 3 WHEN tod_hour < 18 THEN 4 ELSE 5 END AS bin, round(avg(abs(dur_s - naismith_s)) / 60, 4) AS mae_min, count(*) AS n FROM fx_s GROUP BY 1")
def _(t):
    return t.fx_s.groupBy(report_bin("tod_hour").alias("bin")).agg(F.round(F.avg(F.abs(F.col("dur_s") - F.col("naismith_s"))) / 60, 4).alias("mae_min"), F.count("*").alias("n"))


@query("segment_summary", "SELECT scene, count(DISTINCT track) AS n_track, count(*) AS n_seg, round(median(dur_s), 3) AS dur, round(median(dist_m), 3) AS dist, round(median(up_m), 3) AS climb FROM fx_s GROUP BY scene")
def _(t):
    return t.fx_s.groupBy("scene").agg(F.countDistinct("track").alias("n_track"), F.count("*").alias("n_seg"), *(F.round(F.percentile(c, 0.5), 3).alias(a) for c, a in (("dur_s", "dur"), ("dist_m", "dist"), ("up_m", "climb"))))


@query("eligible_scenes", "SELECT scene, count(DISTINCT track_id) AS n FROM fx_p GROUP BY scene HAVING count(DISTINCT track_id) >= 30")
def _(t):
    return t.fx_p.groupBy("scene").agg(F.countDistinct("track_id").alias("n")).where("n >= 30")


@query("multi_seed_summary", "SELECT grp, round(avg(mae_min), 5) AS mean_mae, round(stddev_samp(mae_min), 5) AS sd_mae, count(*) AS n FROM fx_res GROUP BY grp")
def _(t):
    return t.fx_res.groupBy("grp").agg(F.round(F.avg("mae_min"), 5).alias("mean_mae"), F.round(F.stddev_samp("mae_min"), 5).alias("sd_mae"), F.count("*").alias("n"))


@query("macro_weighted", "WITH s AS (SELECT grp, target, avg(mae_min) AS m, sum(n_seg) AS w FROM fx_res GROUP BY 1, 2) SELECT grp, round(avg(m), 5) AS macro, round(sum(m * w) / sum(w), 5) AS weighted FROM s GROUP BY grp")
def _(t):
    s = t.fx_res.groupBy("grp", "target").agg(F.avg("mae_min").alias("m"), F.sum("n_seg").alias("w"))
    return s.groupBy("grp").agg(F.round(F.avg("m"), 5).alias("macro"), F.round(F.sum(F.col("m") * F.col("w")) / F.sum("w"), 5).alias("weighted"))


def paired_differences(results: DataFrame, a: str, b: str) -> DataFrame:
    """(target, d): each scene's mean over seeds of group ``a`` minus group ``b``."""
    p = results.groupBy("target", "seed").agg(F.avg(F.when(F.col("grp") == a, F.col("mae_min"))).alias("a"), F.avg(F.when(F.col("grp") == b, F.col("mae_min"))).alias("b"))
    return p.groupBy("target").agg(F.avg(F.col("a") - F.col("b")).alias("d"))


PAIRS_SQL = "pd AS (SELECT target, seed, avg(CASE WHEN grp = 'no_slope' THEN mae_min END) - avg(CASE WHEN grp = 'full' THEN mae_min END) AS d FROM fx_res GROUP BY 1, 2), sd AS (SELECT target, avg(d) AS d FROM pd GROUP BY target)"


@query("paired_scene_effect", f"WITH {PAIRS_SQL} SELECT round(avg(d), 5) AS mean_d, round(avg(d) - 2.093e0 * stddev_samp(d) / sqrt(count(*)), 5) AS low, round(avg(d) + 2.093e0 * stddev_samp(d) / sqrt(count(*)), 5) AS high, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS above FROM sd")
def _(t):
    half = 2.093 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    return paired_differences(t.fx_res, "no_slope", "full").agg(F.round(F.avg("d"), 5).alias("mean_d"), F.round(F.avg("d") - half, 5).alias("low"), F.round(F.avg("d") + half, 5).alias("high"), F.count_if(F.col("d") > 0).alias("above"))


@query("effect_sizes", f"WITH {PAIRS_SQL}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM sd WHERE d <> 0) SELECT round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - sum(CASE WHEN d < 0 THEN r ELSE 0 END)) / sum(r), 5) AS rank_biserial, round(avg(d) / stddev_samp(d), 5) AS d_z, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r")
def _(t):
    return signed_ranks(paired_differences(t.fx_res, "no_slope", "full")).agg(F.round((F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)) - F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0))) / F.sum("r"), 5).alias("rank_biserial"), F.round(F.avg("d") / F.stddev_samp("d"), 5).alias("d_z"), F.least(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))).alias("w"))


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """Nonzero differences with their average rank by absolute value (one row per scene)."""
    tied = F.count("*").over(Window.partitionBy(F.abs("d")))
    return diffs.where("d != 0").withColumn("r", F.rank().over(Window.orderBy(F.abs("d"))) + (tied - 1) / 2.0)


@query("diebold_mariano", f"WITH d AS (SELECT scene, abs(true_dur - mu) - abs(true_dur - 36e2) AS d FROM fx_pred), s AS (SELECT scene, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS dm FROM d GROUP BY scene HAVING count(*) >= 3 AND stddev_samp(d) > 0) SELECT scene, round(dm, 4) AS dm, round(2 * (1 - {normal_cdf_sql('abs(dm)')}), 4) AS p FROM s")
def _(t):
    d = F.abs(F.col("true_dur") - F.col("mu")) - F.abs(F.col("true_dur") - 3600.0)
    s = t.fx_pred.withColumn("d", d).groupBy("scene").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n")).where("n >= 3 and sd > 0")
    s = s.withColumn("dm", F.col("m") / (F.col("sd") / F.sqrt("n")))
    return s.select("scene", F.round("dm", 4).alias("dm"), F.round(2 * (1 - normal_cdf(F.abs("dm"))), 4).alias("p"))


@query("drift_smd", "WITH a AS (SELECT avg(up_m) m, stddev_pop(up_m) s FROM fx_s WHERE scene < 12), b AS (SELECT scene, avg(up_m) m FROM fx_s WHERE scene >= 12 GROUP BY scene) SELECT scene, round(abs(b.m - a.m) / a.s, 5) AS smd FROM a, b")
def _(t):
    source = t.fx_s.where("scene < 12").agg(F.avg("up_m").alias("m"), F.stddev_pop("up_m").alias("s"))
    return t.fx_s.where("scene >= 12").groupBy("scene").agg(F.avg("up_m").alias("t")).join(F.broadcast(source)).select("scene", F.round(F.abs(F.col("t") - F.col("m")) / F.col("s"), 5).alias("smd"))


@query("concat_scenes", "SELECT scene, count(*) AS n FROM (SELECT scene FROM fx_p UNION ALL SELECT scene FROM fx_r) GROUP BY scene")
def _(t):
    return t.fx_p.select("scene", "lon").unionByName(t.fx_r.select("scene", "region_id"), allowMissingColumns=True).groupBy("scene").agg(F.count("*").alias("n"))


@query("scene_set_ops", "SELECT DISTINCT scene FROM fx_r WHERE scene NOT IN (SELECT scene FROM fx_p)")
def _(t):
    return t.fx_r.select("scene").distinct().join(t.fx_p.select("scene").distinct(), "scene", "left_anti")


@query("top_n", "SELECT region_id, n FROM (SELECT region_id, count(*) AS n FROM fx_r GROUP BY region_id) ORDER BY n DESC, region_id LIMIT 5")
def _(t):
    return t.fx_r.groupBy("region_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region_id").limit(5)
