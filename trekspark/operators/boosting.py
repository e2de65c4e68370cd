"""Learned duration models beyond the linear ones: boosted trees, quantiles, probes, priors with residuals, ladders of models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.graph import dealt, stored
from trekspark.operators.expressions import FEATURE_GROUPS, FEATURES, STEPS_SQL, exact_quantiles, steps
from trekspark.operators.forecast import MARKOV_SQL, most_frequent, markov_next, pair_prior
from trekspark.operators.learned import knn_topk
from trekspark.operators.statistics import markov_rollout, prefix_rows
from trekspark.operators.trajectory import compress_sequence
from trekspark.plans.registry import query

LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def _known(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


@dataclass
class Boosted:
    """Boosted trees of a label that was shifted and scaled."""

    model: Model
    features: list[str]
    centre: float
    scale: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pred, 0 at least; null where a feature is null."""
        there = _known(self.features)
        packed = rows.where(there).select(F.struct("*").alias("_row"), *self.features)  # so that no name of the rows clashes
        out = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_x").transform(packed))
        pred = F.greatest(F.col("_p") * self.scale + self.centre, F.lit(0.0))
        return out.select(*(F.col("_row")[c].alias(c) for c in rows.columns), pred.alias("pred")).unionByName(rows.where(~there).withColumn("pred", F.lit(None).cast("double")))


def fit_boosted(train: DataFrame, features: list[str], label: str = "dur_s", track: str = "track", trees: int = 300, depth: int = 5, rate: float = 0.05, holdout: float = 0.15, seed: int = 0) -> Boosted:
    """Trees boosted on the absolute error, each on 0.8 of rows and features; boosting stops when the error of the held out tracks
    (``holdout`` of them by a hash) grows. Rows with a null feature or label are left out; the label is scaled by its mean absolute deviation,
    since a step of the absolute error is of length one. ValueError without a row to learn from."""
    rows = stored(train.where(_known([*features, label])).select(track, *features, F.col(label).cast("double").alias("_y")))
    centre, n = rows.agg(F.avg("_y"), F.count("*")).first()
    if not n:
        raise ValueError("no train row has all features and a label")
    scale = rows.agg(F.avg(F.abs(F.col("_y") - centre))).first()[0] or 1.0
    held = F.pmod(F.xxhash64(F.col(track).cast("string"), F.lit(seed)), F.lit(1000)) < int(1000 * holdout)
    marked = rows.withColumn("_held", held)
    if marked.where("_held").isEmpty() or marked.where("NOT _held").isEmpty():  # too few tracks to hold any out
        marked = rows.withColumn("_held", F.lit(False)).unionByName(rows.withColumn("_held", F.lit(True)))
    whole = dealt(marked.select(*features, "_held", ((F.col("_y") - centre) / scale).alias("_z")))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(whole).persist(StorageLevel.MEMORY_AND_DISK)  # the fit reads it several times
    trees_of = GBTRegressor(featuresCol="_x", labelCol="_z", predictionCol="_p", lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", validationIndicatorCol="_held", validationTol=0.0, seed=seed)
    model = trees_of.fit(data)
    data.unpersist()
    return Boosted(model, features, centre, scale)


def boosted_duration(train: DataFrame, test: DataFrame, features: list[str], **options) -> DataFrame:
    """``test`` with pred, by ``fit_boosted``."""
    return fit_boosted(train, features, **options).predict(test)


def feature_importance(spark, model: Boosted) -> DataFrame:
    """(feature, gain): what splits on each feature gain, summing to 1."""
    return spark.createDataFrame(list(zip(model.features, map(float, model.model.featureImportances.toArray()))), "feature string, gain double")


SEGMENT_FEATURES = ["dist_m", "up_m", "down_m", "elev_mean", "tod_hour"]


def _split(t) -> tuple[DataFrame, DataFrame]:
    return t.fx_s.where("track % 10 < 7"), t.fx_s.where("track % 10 >= 7")


@query("boosted_duration")
def _(t):
    train, test = _split(t)
    out = boosted_duration(train, test, SEGMENT_FEATURES, trees=20, depth=4, rate=0.2)
    return out.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("dur_s"))), 2).alias("mae"))


@query("feature_importance")
def _(t):
    train, _ = _split(t)
    return feature_importance(train.sparkSession, fit_boosted(train, SEGMENT_FEATURES, trees=10, depth=4, rate=0.2)).withColumn("gain", F.round("gain", 6))


# Quantiles


def residual_quantiles(held: DataFrame, label: str = "dur_s", bins: int = 10, levels: tuple = LEVELS) -> DataFrame:
    """(bin, low, q, n): of held out rows with ``pred``, the quantiles of the residuals of each of ``bins`` ranges of predicted values, exact
    at any size. low: the range's smallest prediction, null for the first."""
    rows = stored(held.where(F.col("pred").isNotNull() & F.col(label).isNotNull()).select("pred", F.col(label).alias("_y")))
    edges = stored(exact_quantiles(rows, [], "pred", [k / bins for k in range(1, bins)], False).withColumnRenamed("q", "_e"))
    met = rows.crossJoin(F.broadcast(edges))  # one row
    placed = stored(met.select(F.size(F.filter("_e", lambda e: e < F.col("pred"))).alias("bin"), (F.col("_y") - F.col("pred")).alias("_r")))
    q = exact_quantiles(placed, ["bin"], "_r", list(levels), False)
    n = placed.groupBy("bin").agg(F.count("*").alias("n")).crossJoin(F.broadcast(edges)).select("bin", F.get("_e", F.col("bin") - 1).alias("low"), "n")
    return n.join(q, "bin").select("bin", "low", "q", "n")


def quantile_duration(test: DataFrame, table: DataFrame, levels: tuple = LEVELS) -> DataFrame:
    """``test`` (with pred) with q: an array of (level l, value p), the prediction and its range's residual quantiles, 0 at least. A
    prediction below all ranges takes the first, so none is left without; null predictions have a null q."""
    listed = table.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("low", F.lit(float("-inf"))).alias("low"), "q"))).alias("_t"))
    met = test.crossJoin(F.broadcast(listed))  # one row of at most as many entries as bins
    at = F.filter("_t", lambda x: x["low"] < F.col("pred"))
    own = F.coalesce(F.try_element_at(at, F.lit(-1)), F.get("_t", F.lit(0)))["q"]
    each = F.array(*(F.struct(F.lit(a).alias("l"), F.greatest(F.col("pred") + own[k], F.lit(0.0)).alias("p")) for k, a in enumerate(levels)))
    return met.withColumn("q", F.when(F.col("pred").isNotNull(), each)).drop("_t")


_LINE = "390e0 + 4 * up_m + down_m"
QUANTILE_SQL = f"""ho AS (SELECT {_LINE} AS pred, dur_s FROM fx_s WHERE track % 10 = 6), ed AS (SELECT quantile_disc({_LINE}, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS e FROM fx_s WHERE track % 10 = 6),
bi AS (SELECT len(list_filter(e, lambda x: x < pred)) AS bin, e, pred, dur_s FROM ho CROSS JOIN ed), ta AS (SELECT bin, any_value(e[bin]) AS low, quantile_disc(dur_s - pred, [5e-2, 1e-1, 25e-2, 5e-1, 75e-2, 9e-1, 95e-2]) AS q, count(*) AS n FROM bi GROUP BY bin)"""


@query("quantile_duration", f"WITH {QUANTILE_SQL} SELECT CAST(bin AS INT) AS bin, round(low, 4) AS low, n, round(q[1], 4) AS p05, round(q[4], 4) AS p50, round(q[7], 4) AS p95 FROM ta")
def _(t):
    held = t.fx_s.where("track % 10 = 6").withColumn("pred", F.expr(_LINE))
    table = residual_quantiles(held)
    return table.select("bin", F.round("low", 4).alias("low"), "n", *(F.round(F.col("q")[k], 4).alias(c) for k, c in ((0, "p05"), (3, "p50"), (6, "p95"))))


# Which scene a segment is of


def scene_probe(train: DataFrame, test: DataFrame, features: list[str], label: str = "scene", trees: int = 50, depth: int = 8, seed: int = 0) -> DataFrame:
    """(n, classes, accuracy, chance): how well a forest tells the label from the features on other rows; chance is one over the classes of
    train. Rows with a null feature or label, and test rows of a class that train lacks, are left out."""
    names = StringIndexer(inputCol="_label", outputCol="_i", handleInvalid="skip")
    text = lambda df: df.where(_known(features) & F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("string"))
    gather = VectorAssembler(inputCols=features, outputCol="_x")
    index = names.fit(text(train))
    rows = lambda df: gather.transform(index.transform(text(df)))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_i", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed).fit(rows(train))
    out = model.transform(rows(test))
    return out.agg(F.count("*").alias("n"), F.avg((F.col("_p") == F.col("_i")).cast("double")).alias("accuracy")).select("n", F.lit(len(index.labels)).alias("classes"), "accuracy", F.lit(1.0 / len(index.labels)).alias("chance"))


@query("scene_probe")
def _(t):
    part = F.floor(F.col("track") / 20) % 10  # the scene is the track's number modulo 20
    return scene_probe(t.fx_s.where(part < 7), t.fx_s.where(part >= 7), SEGMENT_FEATURES, trees=10, depth=5).withColumn("accuracy", F.round("accuracy", 4))


# Steps with a predicted next region


def step_features(rows: DataFrame, nxt: str, prior: DataFrame) -> DataFrame:
    """``rows`` with mu (the pair prior of its region and ``nxt``, else the mean over all pairs), hour and first (is it the first step)."""
    overall = prior.agg((F.sum(F.col("mu") * F.col("n")) / F.sum("n")).alias("_all"))
    pair = prior.select("region_id", F.col("nxt").alias(nxt), F.col("mu").alias("_mu"))
    met = rows.join(pair, ["region_id", nxt], "left").crossJoin(F.broadcast(overall))  # one row
    return met.withColumns({"mu": F.coalesce("_mu", "_all"), "hour": F.pmod(F.col("t_s") / 3600, F.lit(24.0)), "at": F.col("pos").cast("double")}).drop("_mu", "_all")


STEP_FEATURES = ["mu", "hour", "at"]


def two_stage_duration(train: DataFrame, test: DataFrame, predictors: dict[str, DataFrame], **options) -> DataFrame:
    """(predictor, n, next_hit, mae): one boosted duration model, fitted on the true next regions of train, scored on test steps with the next regions
    that each predictor gives (track_id, pos, pred). Steps that a predictor lacks keep their region."""
    prior = stored(pair_prior(train))
    model = fit_boosted(step_features(train.where("nxt IS NOT NULL"), "nxt", prior), STEP_FEATURES, "dur", "track_id", **options)
    out = None
    for name, given in predictors.items():
        met = test.where("nxt IS NOT NULL").join(given.select("track_id", "pos", "pred"), ["track_id", "pos"], "left")
        met = met.withColumn("_next", F.coalesce("pred", "region_id")).drop("pred")
        scored = model.predict(step_features(met, "_next", prior))
        row = scored.agg(F.count("*").alias("n"), F.avg((F.col("_next") == F.col("nxt")).cast("double")).alias("next_hit"), F.avg(F.abs(F.col("pred") - F.col("dur"))).alias("mae"))
        row = row.select(F.lit(name).alias("predictor"), "n", "next_hit", "mae")
        out = row if out is None else out.unionByName(row)
    return out


def _step_split(t) -> tuple[DataFrame, DataFrame]:
    s = stored(steps(t.fx_r))
    return s.where("track_id % 10 < 7"), s.where("track_id % 10 >= 7")


@query("two_stage_duration")
def _(t):
    train, test = _step_split(t)
    predictors = {"true": test.select("track_id", "pos", F.col("nxt").alias("pred")), "markov": markov_next(test, train).select("track_id", "pos", "pred"), "stay": test.select("track_id", "pos", F.col("region_id").alias("pred"))}
    out = two_stage_duration(train, test, predictors, trees=8, depth=3, rate=0.3)
    return out.withColumns({"next_hit": F.round("next_hit", 6), "mae": F.round("mae", 3)})


def prior_plus_residual(test: DataFrame, prior: DataFrame, residual: Column) -> DataFrame:
    """``test`` (with pred, the predicted next region) with forecast and sigma: the prior of the pair plus ``residual``, 0 at least, and
    the pair's deviation; pairs that train lacks, or saw once, have the mean over all pairs, or the deviation of all."""
    total = prior.agg((F.sum(F.col("mu") * F.col("n")) / F.sum("n")).alias("_all"), F.avg("sigma").alias("_sd"))
    pair = prior.select("region_id", F.col("nxt").alias("pred"), "mu", "sigma")
    met = test.join(pair, ["region_id", "pred"], "left").crossJoin(F.broadcast(total))  # one row
    return met.withColumns({"forecast": F.greatest(F.coalesce("mu", "_all") + residual, F.lit(0.0)), "sigma": F.coalesce("sigma", "_sd")}).drop("mu", "_all", "_sd")


PRIOR_SQL = f"{MARKOV_SQL}, pp AS (SELECT region_id, nxt, avg(dur) AS mu, stddev_samp(dur) AS sigma, count(*) AS n FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1, 2), al AS (SELECT sum(mu * n) / sum(n) AS mu, avg(sigma) AS sigma FROM pp)"
RESIDUAL_SQL = ", rs AS (SELECT st.region_id, avg(st.dur - coalesce(pp.mu, al.mu)) AS res FROM st LEFT JOIN mk USING (region_id) CROSS JOIN gb LEFT JOIN pp ON pp.region_id = st.region_id AND pp.nxt = coalesce(pred, best) CROSS JOIN al WHERE st.nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY 1)"


@query("prior_plus_residual", f"WITH {PRIOR_SQL}{RESIDUAL_SQL} SELECT st.track_id, st.pos, round(greatest(coalesce(pp.mu, al.mu) + coalesce(res, 0), 0e0), 3) AS forecast, round(coalesce(pp.sigma, al.sigma), 3) AS sigma FROM st LEFT JOIN mk USING (region_id) CROSS JOIN gb LEFT JOIN pp ON pp.region_id = st.region_id AND pp.nxt = coalesce(pred, best) CROSS JOIN al LEFT JOIN rs ON rs.region_id = st.region_id WHERE st.nxt IS NOT NULL AND st.track_id % 10 >= 7")
def _(t):
    """The residual is what train steps of the region miss on average when their next region is predicted."""
    train, test = _step_split(t)
    prior = stored(pair_prior(train))
    ahead = lambda s: markov_next(s.where("nxt IS NOT NULL"), train)
    missed = prior_plus_residual(ahead(train), prior, F.lit(0.0)).groupBy("region_id").agg(F.avg(F.col("dur") - F.col("forecast")).alias("_res"))
    out = prior_plus_residual(ahead(test).join(missed, "region_id", "left"), prior, F.coalesce("_res", F.lit(0.0)))
    return out.select("track_id", "pos", F.round("forecast", 3).alias("forecast"), F.round("sigma", 3).alias("sigma"))


# Retrieval, rollouts and their errors


def timed_sequences(visits: DataFrame) -> DataFrame:
    """(track_id, seq, durs, arrivals): compressed regions, the time from each to the next (one fewer) and since the first."""
    rows = compress_sequence(visits).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("t_s", "event_id", "region_id"))).alias("_s"))
    t = F.col("_s.t_s")
    later = F.zip_with(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), t, lambda b, a: b - a)
    return rows.select("track_id", F.col("_s.region_id").alias("seq"), F.slice(later, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("durs"), F.transform(t, lambda x: x - t[0]).alias("arrivals"))


def retrieve_completion(test: DataFrame, train: DataFrame, prefix: int = 2, least: int = 3, most: int = 5) -> DataFrame:
    """(track_id, j, pred, dur, votes): the steps after a test track's first ``prefix`` regions, as train tracks go on.

    Train tracks are those that share the whole prefix and go on after it; with fewer than ``least`` of them a shorter prefix, at last one of a single
    region, however few. Step j (from 1 to ``most``) takes the most common region there (ties to the smaller) and the mean
    time to the next; steps end where no train track goes on. Counts are taken per prefix and step, so tracks do not meet in pairs.
    ``test`` and ``train``: track_id, seq, durs; test tracks of fewer than ``prefix`` regions are left out.
    """
    p = prefix_rows(train, prefix).where(F.size("seq") > F.col("m"))
    votes = p.groupBy("prefix", "m").agg(F.count("*").alias("votes"))
    chosen = prefix_rows(test.where(F.size("seq") >= prefix), prefix).join(votes.drop("m"), "prefix").where((F.col("votes") >= least) | (F.col("m") == 1))
    best = chosen.groupBy("track_id").agg(F.max(F.struct("m", "prefix")).alias("b")).select("track_id", "b.prefix")
    tail = p.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_r", F.get("seq", F.col("j") + prefix - 1)).where("_r IS NOT NULL")
    region = most_frequent(tail, ["prefix", "j"], "_r").select("prefix", "j", F.col("_r").alias("pred"), F.col("n").alias("votes"))
    dur = tail.groupBy("prefix", "j").agg(F.coalesce(F.avg(F.get("durs", F.col("j") + prefix - 1)), F.lit(0.0)).alias("dur"))
    return best.join(region.join(dur, ["prefix", "j"]), "prefix").select("track_id", "j", "pred", "dur", "votes")


COMPLETION_SQL = """cs AS (SELECT track_id, region_id, t_s, event_id FROM (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM fx_r) WHERE b IS NULL OR b <> region_id),
ts AS (SELECT track_id, region_id, t_s, lead(t_s) OVER w - t_s AS dur, row_number() OVER w AS i FROM cs WINDOW w AS (PARTITION BY track_id ORDER BY t_s, event_id)),
sq AS (SELECT track_id, list(region_id ORDER BY i) AS seq, list(dur ORDER BY i) AS durs FROM ts GROUP BY 1), pr AS (SELECT track_id, seq, durs, m, array_to_string(seq[1:m], ',') AS prefix FROM sq, (VALUES (1), (2)) v(m) WHERE m <= len(seq)),
vo AS (SELECT prefix, m, count(*) AS votes FROM pr WHERE track_id % 10 < 7 AND len(seq) > m GROUP BY 1, 2), be AS (SELECT track_id, arg_max(pr.prefix, pr.m) AS prefix FROM pr JOIN vo USING (prefix, m) WHERE track_id % 10 >= 7 AND len(seq) >= 2 AND (votes >= 3 OR m = 1) GROUP BY 1),
ta AS (SELECT prefix, j, seq[j + 2] AS r, durs[j + 2] AS dur FROM pr, (VALUES (1), (2), (3), (4), (5)) w(j) WHERE track_id % 10 < 7 AND len(seq) > m AND len(seq) >= j + 2),
mo AS (SELECT prefix, j, r, n FROM (SELECT prefix, j, r, count(*) AS n, row_number() OVER (PARTITION BY prefix, j ORDER BY count(*) DESC, r) AS k FROM ta GROUP BY 1, 2, 3) WHERE k = 1),
co AS (SELECT be.track_id, mo.j, mo.r AS pred, coalesce(d.dur, 0) AS dur, mo.n AS votes FROM be JOIN mo USING (prefix) JOIN (SELECT prefix, j, avg(dur) AS dur FROM ta GROUP BY 1, 2) d ON d.prefix = mo.prefix AND d.j = mo.j)"""


@query("retrieve_completion", f"WITH {COMPLETION_SQL} SELECT track_id, CAST(j AS INT) AS j, pred, round(dur, 3) AS dur, votes FROM co")
def _(t):
    s = stored(timed_sequences(t.fx_r))
    return retrieve_completion(s.where("track_id % 10 >= 7"), s.where("track_id % 10 < 7")).withColumn("dur", F.round("dur", 3))


def rollout_scores(test: DataFrame, train: DataFrame, prefix: int = 2) -> DataFrame:
    """(step, n, accuracy, arrival_mae, arrival_mape): Markov rollouts of test tracks against their true steps, by steps after the prefix;
    step null is all of them. An arrival is the true time at the prefix's end plus the pair priors of the predicted
    steps (the mean over all pairs for new ones); shares of the true time leave out arrivals at time 0."""
    ahead = markov_rollout(test, train, prefix)
    at = test.select("track_id", "pos", F.col("region_id").alias("true"), (F.col("t_s") - F.min("t_s").over(Window.partitionBy("track_id"))).alias("arrival"))
    start = at.where(F.col("pos") == prefix).select("track_id", "pos", F.col("true").alias("pred"), F.lit(0).alias("_step"))
    chain = ahead.select("track_id", "pos", "pred", (F.col("pos") - prefix).alias("_step")).unionByName(start)
    by = Window.partitionBy("track_id").orderBy("pos")
    prior = pair_prior(train)
    overall = prior.agg((F.sum(F.col("mu") * F.col("n")) / F.sum("n")).alias("_all"))
    moved = chain.withColumn("region_id", F.lag("pred").over(by)).join(prior.select("region_id", F.col("nxt").alias("pred"), "mu"), ["region_id", "pred"], "left").crossJoin(F.broadcast(overall))  # one row
    first = at.where(F.col("pos") == prefix).select("track_id", F.col("arrival").alias("_from"))
    timed = moved.withColumn("_t", F.sum(F.when(F.col("_step") > 0, F.coalesce("mu", "_all")).otherwise(0.0)).over(by)).where("_step > 0").join(first, "track_id").join(at, ["track_id", "pos"])
    err = F.abs(F.col("_from") + F.col("_t") - F.col("arrival"))
    each = timed.select(F.col("_step").cast("int").alias("step"), (F.col("pred") == F.col("true")).cast("double").alias("hit"), err.alias("err"), (err / F.nullif(F.col("arrival"), F.lit(0.0))).alias("share"))
    return each.rollup("step").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("err").alias("arrival_mae"), F.avg("share").alias("arrival_mape"))


ROLL_SQL = f"""{PRIOR_SQL}, ln AS (SELECT track_id, max(pos) AS n, min(t_s) AS t0 FROM st GROUP BY 1), ro AS (SELECT track_id, pos, region_id AS cur, CAST(NULL AS INT) AS prev FROM st WHERE pos = 2 AND track_id % 10 >= 7
UNION ALL SELECT ro.track_id, CAST(ro.pos + 1 AS INT), coalesce(mk.pred, gb.best), ro.cur FROM ro JOIN ln ON ln.track_id = ro.track_id LEFT JOIN mk ON mk.region_id = ro.cur CROSS JOIN gb WHERE ro.pos < ln.n),
rt AS (SELECT ro.*, sum(CASE WHEN ro.pos > 2 THEN coalesce(pp.mu, al.mu) ELSE 0 END) OVER (PARTITION BY ro.track_id ORDER BY ro.pos) AS t FROM ro LEFT JOIN pp ON pp.region_id = ro.prev AND pp.nxt = ro.cur CROSS JOIN al),
ev AS (SELECT rt.track_id, rt.pos - 2 AS step, rt.cur, st.region_id AS tru, f.t_s - ln.t0 + rt.t AS est, st.t_s - ln.t0 AS arr FROM rt JOIN st ON st.track_id = rt.track_id AND st.pos = rt.pos JOIN ln ON ln.track_id = rt.track_id JOIN st f ON f.track_id = rt.track_id AND f.pos = 2 WHERE rt.pos > 2)"""


@query("rollout_scores", f"WITH RECURSIVE {ROLL_SQL} SELECT CAST(step AS INT) AS step, count(*) AS n, round(avg(CASE WHEN cur = tru THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(abs(est - arr)), 3) AS arrival_mae, round(avg(abs(est - arr) / nullif(arr, 0)), 5) AS arrival_mape FROM ev GROUP BY ROLLUP (step)")
def _(t):
    train, test = _step_split(t)
    out = rollout_scores(test, train)
    return out.select("step", "n", F.round("accuracy", 6).alias("accuracy"), F.round("arrival_mae", 3).alias("arrival_mae"), F.round("arrival_mape", 5).alias("arrival_mape"))


def source_estimator_grid(true: DataFrame, sources: dict[str, DataFrame], estimators: dict[str, callable]) -> DataFrame:
    """(source, estimator, n, cum_mae): the error of arrival times when each source names the next regions and each estimator gives their times.

    ``true``: track_id, j, region_id, dur (step j after the prefix and its time). A source is (track_id, j, nxt, ...): what it says
    comes after step j; an estimator turns true steps joined with a source into ``est``. Times are summed along a track from its first step that the
    source has on; steps that it lacks are passed over on both sides."""
    out = None
    for s, given in sources.items():
        met = true.join(given, ["track_id", "j"])
        for e, estimate in estimators.items():
            got = estimate(s, met)
            if got is None:
                continue
            by = Window.partitionBy("track_id").orderBy("j")
            summed = got.where("est IS NOT NULL AND dur IS NOT NULL").select((F.sum("est").over(by) - F.sum("dur").over(by)).alias("gap"))
            row = summed.agg(F.count("*").alias("n"), F.avg(F.abs("gap")).alias("cum_mae")).select(F.lit(s).alias("source"), F.lit(e).alias("estimator"), "n", "cum_mae")
            out = row if out is None else out.unionByName(row)
    return out


@query("source_estimator_grid")
def _(t):
    """Regions from retrieval, Markov steps or the truth; times from the retrieved tracks, the pair prior or boosted trees."""
    visits = compress_sequence(t.fx_r)
    s = stored(steps(visits))
    train, test = s.where("track_id % 10 < 7"), s.where("track_id % 10 >= 7")
    timed = stored(timed_sequences(t.fx_r))
    completion = retrieve_completion(timed.where("track_id % 10 >= 7"), timed.where("track_id % 10 < 7"))
    true = test.where("pos > 2 AND nxt IS NOT NULL").select("track_id", (F.col("pos") - 2).alias("j"), "region_id", "dur", "nxt", "t_s", "pos")
    prior = stored(pair_prior(train))
    model = fit_boosted(step_features(train.where("nxt IS NOT NULL"), "nxt", prior), STEP_FEATURES, "dur", "track_id", trees=5, depth=3, rate=0.3)
    said = completion.select("track_id", "j", F.col("dur").alias("_kept"), F.lead("pred").over(Window.partitionBy("track_id").orderBy("j")).alias("_next"))
    walked = markov_next(test, train).where("pos > 2").select("track_id", (F.col("pos") - 2).alias("j"), F.col("pred").alias("_next"))
    sources = {"retrieval": said.withColumn("_next", F.coalesce("_next", F.lit(-1))), "markov": walked.withColumn("_kept", F.lit(None).cast("double")), "true": true.select("track_id", "j", F.col("nxt").alias("_next"), F.lit(None).cast("double").alias("_kept"))}
    estimators = {
        "suffix": lambda s, m: m.withColumn("est", F.col("_kept")) if s == "retrieval" else None,
        "prior": lambda s, m: step_features(m, "_next", prior).withColumn("est", F.col("mu")),
        "boosted": lambda s, m: model.predict(step_features(m, "_next", prior)).withColumn("est", F.col("pred")),
    }
    return source_estimator_grid(true, sources, estimators).withColumn("cum_mae", F.round("cum_mae", 2))


# Ladders of models over scenes


def gram_sums(df: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    """Per key the sums of products of (1, features, label), as columns s_i_j: all that ridge regressions of any features
    and any union of keys need."""
    v = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(label).cast("double")]
    there = df.where(_known([*features, label]))
    return there.groupBy(*keys).agg(*(F.sum(v[i] * v[j]).alias(f"s_{i}_{j}") for i in range(len(v)) for j in range(i, len(v))))


def _ridge(sums: np.ndarray, use: list[int], alpha: float) -> np.ndarray:
    """Intercept and weights on scaled features, from sums of products; ``use`` are places of features."""
    n = max(sums[0, 0], 1.0)
    mean = sums[0, use] / n
    cov = sums[np.ix_(use, use)] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-6
    y = sums[0, -1] / n
    xy = (sums[use, -1] / n - mean * y) / sd
    w = np.linalg.solve(cov / np.outer(sd, sd) + alpha / n * np.eye(len(use)), xy) / sd
    return np.concatenate([[y - w @ mean], w])


def benchmark_rows(df: DataFrame, groups: dict[str, list[str]] = FEATURE_GROUPS, label: str = "dur_s", seeds: tuple = (42,), alpha: float = 1.0) -> DataFrame:
    """(target, seed, model, setting, grp, mae_min, n_seg, n_track): the result rows of a leave-one-scene-out run.

    For each seed whole tracks of a scene are split 70 to 30 by a hash. Each scene is a target once: "naismith" needs no fit, ridge
    is fitted zero-shot on the train tracks of all other scenes, or on its own ("self-train"), once for each feature group. Sums of products
    per scene serve all these fits, so the rows are read twice a seed, whatever the number of scenes and groups;
    the driver solves systems of a few features. Rows with a null feature or label are left out.
    """
    features = list(dict.fromkeys(f for g in groups.values() for f in g))
    out = None
    for seed in seeds:
        rows = df.where(_known([*features, label])).withColumn("_train", F.pmod(F.xxhash64(F.col("track").cast("string"), F.lit(seed)), F.lit(10)) < 7)
        sums = {}
        for r in gram_sums(rows.where("_train"), features, label, ["scene"]).collect():  # a row a scene
            m = np.zeros((len(features) + 2,) * 2)
            for i in range(len(m)):
                for j in range(i, len(m)):
                    m[i, j] = m[j, i] = r[f"s_{i}_{j}"]
            sums[r.scene] = m
        total = sum(sums.values(), np.zeros((len(features) + 2,) * 2))
        fitted = []
        for scene, own in sums.items():
            for g, columns in groups.items():
                use = [1 + features.index(c) for c in columns]
                for setting, m in (("zero-shot", total - own), ("self-train", own)):
                    if m[0, 0] < 1:
                        continue
                    w = np.zeros(len(features) + 1)
                    w[[0, *use]] = _ridge(m, use, alpha)
                    fitted.append((scene, "ridge", setting, g, w.tolist()))
        models = df.sparkSession.createDataFrame(fitted, f"scene {df.schema['scene'].dataType.simpleString()}, model string, setting string, grp string, w array<double>")
        held = rows.where("NOT _train").select("scene", "track", label, F.col("naismith_s").alias("_n"), F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features)).alias("_v"))
        said = F.greatest(F.aggregate(F.zip_with("_v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
        scored = held.join(F.broadcast(models), "scene").select("scene", "model", "setting", "grp", "track", F.abs(said - F.col(label)).alias("err"))  # a row a scene, setting and group
        physics = held.select("scene", F.lit("naismith").alias("model"), F.lit("physics").alias("setting"), F.lit("full").alias("grp"), "track", F.abs(F.col("_n") - F.col(label)).alias("err"))
        one = scored.unionByName(physics).groupBy(F.col("scene").alias("target"), "model", "setting", "grp").agg((F.avg("err") / 60).alias("mae_min"), F.count("*").alias("n_seg"), F.countDistinct("track").alias("n_track"))
        one = one.withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out.select("target", "seed", "model", "setting", "grp", "mae_min", "n_seg", "n_track")


@query("benchmark_rows")
def _(t):
    return benchmark_rows(t.fx_s, {"full": FEATURES}, seeds=(42, 43)).withColumn("mae_min", F.round("mae_min", 4))


def ablation_ladder(rows: DataFrame) -> DataFrame:
    """(grp, scenes, mae_min, change): mean error over targets of each feature group's zero-shot fits, the physics row as "naismith", and the change
    against the full group."""
    mean = rows.where("setting IN ('zero-shot', 'physics')").groupBy(F.when(F.col("model") == "naismith", "naismith").otherwise(F.col("grp")).alias("grp")).agg(F.countDistinct("target").alias("scenes"), F.avg("mae_min").alias("mae_min"))
    full = F.max(F.when(F.col("grp") == "full", F.col("mae_min"))).over(Window.partitionBy(F.lit(1)))  # a row a group
    return mean.withColumn("change", F.col("mae_min") - full)


@query("ablation_ladder")
def _(t):
    return ablation_ladder(benchmark_rows(t.fx_s)).withColumns({"mae_min": F.round("mae_min", 4), "change": F.round("change", 4)})


# A memory of train steps


def memory_prior(neighbours: DataFrame, scores: DataFrame, truth: DataFrame, lambdas: tuple = (0.0, 0.25, 0.5, 1.0, 2.0), temperature: float = 0.1) -> DataFrame:
    """(lambda, n, hits, accuracy, best): the accuracy of the label of largest score + lambda log P, for each lambda in one pass.

    ``neighbours``: q, sim, label of the most similar train rows; P is the share of their weights exp(sim / temperature) that a label has. ``scores``:
    q, label, score for all labels of a query; ``truth``: q, label. Ties go to the smaller label; best is the smallest lambda of the largest
    accuracy."""
    top = F.max("sim").over(Window.partitionBy("q"))
    w = neighbours.withColumn("_w", F.exp((F.col("sim") - top) / temperature)).groupBy("q", "label").agg(F.sum("_w").alias("_w"))
    share = w.withColumn("_p", F.col("_w") / (F.sum("_w").over(Window.partitionBy("q")) + 1e-9)).drop("_w")
    met = scores.join(share, ["q", "label"], "left").withColumn("_log", F.log(F.coalesce("_p", F.lit(0.0)) + 1e-9))
    each = met.withColumn("lambda", F.explode(F.array(*(F.lit(float(x)) for x in lambdas))))
    said = each.groupBy("q", "lambda").agg(F.max(F.struct(F.round(F.col("score") + F.col("lambda") * F.col("_log"), 9).alias("s"), (-F.col("label")).alias("l"))).alias("b"))
    hit = said.join(truth.select("q", F.col("label").alias("_true")), "q").groupBy("lambda").agg(F.count("*").alias("n"), F.sum((-F.col("b.l") == F.col("_true")).cast("long")).alias("hits"))
    out = hit.withColumn("accuracy", F.col("hits") / F.col("n"))
    return out.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("hits"), "lambda")) == 1)  # a row a lambda


MEMORY_SQL = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings), u AS (SELECT vec_id, label, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS v FROM e),
pr AS (SELECT q.vec_id AS q, t.vec_id AS id, t.label, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * t.v[i])) AS sim FROM u q JOIN u t ON q.vec_id <> t.vec_id WHERE q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(greatest(2 - 2 * sim, 0)), 9), id) AS k FROM pr) WHERE k <= 50),
ws AS (SELECT q, label, sum(exp(sim / 1e-1)) AS w FROM nb GROUP BY 1, 2), sh AS (SELECT q, label, w / (sum(w) OVER (PARTITION BY q)) AS p FROM ws),
fr AS (SELECT label, ln(count(*)) AS score FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY 1),
sc AS (SELECT u.vec_id AS q, u.label AS tru, fr.label, fr.score, ln(coalesce(p, 0) + 1e-9) AS lg FROM u CROSS JOIN fr LEFT JOIN sh ON sh.q = u.vec_id AND sh.label = fr.label WHERE u.vec_id % 10 = 0),
sa AS (SELECT q, any_value(tru) AS tru, l, arg_min(label, (-round(score + l * lg, 6), label)) AS said FROM sc CROSS JOIN (VALUES (0e0), (25e-2), (5e-1), (1e0), (2e0)) AS g(l) GROUP BY q, l)"""


@query("memory_prior", f"WITH {MEMORY_SQL} SELECT l AS lambda, count(*) AS n, CAST(sum(CASE WHEN said = tru THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN said = tru THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM sa GROUP BY l")
def _(t):
    """Labels of held out vectors (one in ten) from how common a label is, and a memory of all other vectors."""
    raw = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = raw.withColumn("v", F.transform(F.array(norm), lambda n: F.transform("v", lambda x: x / n))[0])  # the norm once a row, not once a component
    held, train = unit.where("id % 10 = 0"), unit.where("id % 10 != 0")
    near = knn_topk(held.select(F.col("id").alias("q"), "v"), train.select("id", "v"), 50)
    near = near.join(train.select("id", "label"), "id").select("q", (1 - F.col("dist") * F.col("dist") / 2).alias("sim"), "label")
    often = train.groupBy("label").agg(F.log(F.count("*")).alias("score"))
    scores = held.select(F.col("id").alias("q")).crossJoin(F.broadcast(often))  # a row a label
    out = memory_prior(near, scores, held.select(F.col("id").alias("q"), "label"))
    return out.select("lambda", "n", "hits", F.round("accuracy", 6).alias("accuracy"))
