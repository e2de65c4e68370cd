"""Splits and protocols, retrieval forecasts, agreement scores and rank statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekspark.graph import stored
from trekspark.operators.expressions import STEPS_SQL, normal_cdf, steps
from trekspark.operators.forecast import MARKOV_SQL, PAIRS_SQL, hash_rank, markov_next, most_frequent, paired_differences, signed_ranks
from trekspark.operators.trajectory import sequences
from trekspark.plans.registry import query


# Splits and protocols


def hash_order(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


@query("split_validation", "WITH k AS (SELECT track_id, row_number() OVER (ORDER BY md5('42|' || CAST(track_id AS VARCHAR)), track_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT track_id FROM fx_r WHERE track_id % 10 < 7)) SELECT track_id, k > least(n - 1, floor(n * 85e-2)) AS val FROM k")
def _(t):
    return split_validation(t.fx_r.where("track_id % 10 < 7"), "track_id").select("track_id", "val").distinct()


def split_validation(df: DataFrame, track: str, ratio: float = 0.85, seed: int = 42) -> DataFrame:
    """``df`` with val: the last tracks in hash order, 1 - ``ratio`` of them and at least one."""
    k = hash_rank(df.select(track).distinct(), [track], seed)
    return df.join(k.select(track, (F.col("_k") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * ratio))).alias("val")), track)


def matched_size(source: DataFrame, extra: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Rows of ``setting`` A (source and extra) and B (extra, and as many source rows in hash order as keep the source's size)."""
    extras = F.broadcast(extra.agg(F.count("*").alias("_m")))  # one row
    less = hash_rank(source, key, seed).join(extras).where(F.col("_k") <= F.col("_n") - F.col("_m")).select(source.columns)
    named = lambda df, s: df.withColumn("setting", F.lit(s))
    return named(source.unionByName(extra), "A").unionByName(named(less.unionByName(extra), "B"))


@query("matched_size_sets", "WITH s AS (SELECT track, seg_idx, row_number() OVER (ORDER BY md5('42|' || CAST(track AS VARCHAR) || '|' || CAST(seg_idx AS VARCHAR)), track, seg_idx) AS k, count(*) OVER () AS n FROM fx_s WHERE scene < 5), x AS (SELECT track, seg_idx FROM fx_s WHERE scene = 7), m AS (SELECT count(*) AS m FROM x) SELECT 'A' AS setting, track, seg_idx FROM s UNION ALL SELECT 'A', track, seg_idx FROM x UNION ALL SELECT 'B', track, seg_idx FROM s, m WHERE k <= n - m UNION ALL SELECT 'B', track, seg_idx FROM x")
def _(t):
    rows = t.fx_s.select("scene", "track", "seg_idx")
    return matched_size(rows.where("scene < 5").drop("scene"), rows.where("scene = 7").drop("scene"), ["track", "seg_idx"])


@query("leave_one_user_out", "WITH u AS (SELECT DISTINCT route_id AS usr FROM fx_r) SELECT usr AS fold, route_id = usr AS test, count(*) AS n, count(DISTINCT track_id) AS tracks FROM fx_r CROSS JOIN u WHERE (SELECT count(*) FROM u) >= 2 GROUP BY 1, 2")
def _(t):
    r = t.fx_r.groupBy("route_id", "track_id").agg(F.count("*").alias("n"))
    return leave_one_user_out(r, "route_id").groupBy("fold", "test").agg(F.sum("n").alias("n"), F.countDistinct("track_id").alias("tracks"))


def leave_one_user_out(df: DataFrame, user: str) -> DataFrame:
    """Each row once per fold, with test: whether it belongs to the fold's user. No fold with fewer than two users."""
    users = df.select(F.col(user).alias("fold")).distinct()
    some = users.agg(F.count("*").alias("_n"), F.collect_list("fold").alias("_f")).where("_n >= 2")  # the protocol's users, a handful
    return df.join(F.broadcast(some)).withColumn("fold", F.explode("_f")).withColumn("test", F.col(user) == F.col("fold")).drop("_n", "_f")


def split_by_route(tracks: DataFrame, seed: int = 42) -> DataFrame:
    """(route_id, track_id) with part: 80/10/10 within each route in hash order, at least one train and one validation track."""
    w = Window.partitionBy("route_id")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(*hash_order(seed, "track_id")))
    train, val = F.greatest(F.lit(1), F.floor(n * 0.8)), F.greatest(F.lit(1), F.floor(n * 0.1))
    return tracks.withColumn("part", F.when(k <= train, "train").when(k <= train + val, "val").otherwise("test"))


@query("split_by_route", "WITH k AS (SELECT route_id, track_id, row_number() OVER (PARTITION BY route_id ORDER BY md5('42|' || CAST(track_id AS VARCHAR)), track_id) AS k, count(*) OVER (PARTITION BY route_id) AS n FROM (SELECT DISTINCT route_id, track_id FROM fx_r)) SELECT route_id, track_id, CASE WHEN k <= greatest(1, floor(n * 8e-1)) THEN 'train' WHEN k <= greatest(1, floor(n * 8e-1)) + greatest(1, floor(n * 1e-1)) THEN 'val' ELSE 'test' END AS part FROM k")
def _(t):
    return split_by_route(t.fx_r.select("route_id", "track_id").distinct())


def shuffled_identity(visits: DataFrame, seeds: tuple = (42, 43, 44)) -> DataFrame:
    """Visits with region_id replaced through a fixed permutation of the regions in use, once per seed."""
    ids = visits.select("region_id").distinct()
    maps = None
    for seed in seeds:
        one = ids.withColumn("_k", F.row_number().over(Window.orderBy("region_id")))  # one row per region
        to = ids.select(F.col("region_id").alias("_to"), F.row_number().over(Window.orderBy(*hash_order(seed, "region_id"))).alias("_k"))
        m = one.join(to, "_k").select(F.lit(seed).alias("seed"), "region_id", "_to")
        maps = m if maps is None else maps.unionByName(m)
    return visits.join(maps, "region_id").withColumn("region_id", F.col("_to")).drop("_to")


@query("shuffled_identity", "WITH i AS (SELECT DISTINCT region_id FROM fx_r), a AS (SELECT region_id, row_number() OVER (ORDER BY region_id) AS k FROM i), b AS (SELECT seed, region_id AS to_id, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(region_id AS VARCHAR)), region_id) AS k FROM i CROSS JOIN (VALUES (42), (43), (44)) s(seed)) SELECT b.seed, f.track_id, f.event_id, b.to_id AS region_id FROM fx_r f JOIN a USING (region_id) JOIN b ON a.k = b.k")
def _(t):
    return shuffled_identity(t.fx_r.select("track_id", "event_id", "region_id")).select("seed", "track_id", "event_id", "region_id")


@query("large_to_small", "WITH n AS (SELECT scene, row_number() OVER (ORDER BY count(DISTINCT track) DESC, scene) AS k FROM fx_s GROUP BY scene) SELECT CASE WHEN k <= 12 THEN 'train' ELSE 'test' END AS part, scene, count(*) AS n FROM fx_s JOIN n USING (scene) GROUP BY 1, 2")
def _(t):
    return large_to_small(t.fx_s, 12).groupBy("part", "scene").agg(F.count("*").alias("n"))


def large_to_small(segments: DataFrame, large: int) -> DataFrame:
    """``segments`` with part: train for the ``large`` scenes of most tracks (ties to the smaller id), test for the others."""
    n = segments.groupBy("scene").agg(F.countDistinct("track").alias("_t"))
    rank = F.row_number().over(Window.orderBy(F.desc("_t"), "scene"))  # one row per scene
    return segments.join(n.select("scene", F.when(rank <= large, "train").otherwise("test").alias("part")), "scene")


# Retrieval forecasts


def prefix_rows(seqs: DataFrame, longest: int) -> DataFrame:
    """One row per prefix (up to ``longest`` regions) of each sequence."""
    return seqs.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("seq")))).alias("m")).withColumn("prefix", F.array_join(F.slice("seq", 1, F.col("m")), ","))


def retrieve_next(test: DataFrame, train: DataFrame, prefix: int = 3, least: int = 3) -> DataFrame:
    """(track_id, m, votes, pred): the most common region after the longest prefix (up to ``prefix`` regions of the
    test track) that ``least`` train tracks share. Counts are taken per prefix, so tracks do not meet in pairs."""
    p = prefix_rows(train, prefix).where(F.size("seq") > F.col("m")).withColumn("nxt", F.get("seq", F.col("m")))
    best = most_frequent(p, ["prefix"], "nxt").join(p.groupBy("prefix").agg(F.count("*").alias("votes")), "prefix").where(F.col("votes") >= least)
    met = prefix_rows(test, prefix).join(best.select("prefix", "votes", F.col("nxt").alias("pred")), "prefix")
    return met.groupBy("track_id").agg(F.max_by(F.struct("m", "votes", "pred"), "m").alias("_b")).select("track_id", "_b.*")


SEQS_SQL = "cs AS (SELECT track_id, route_id, region_id, t_s, event_id FROM (SELECT *, lag(region_id) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS b FROM fx_r) WHERE b IS NULL OR b <> region_id), sq AS (SELECT track_id, list(region_id ORDER BY t_s, event_id) AS seq FROM cs GROUP BY 1)"


@query("retrieve_suffix", f"WITH {SEQS_SQL}, pr AS (SELECT track_id, seq, m, array_to_string(seq[1:m], ',') AS prefix FROM sq, (VALUES (1), (2), (3)) v(m) WHERE m <= len(seq)), tr AS (SELECT prefix, seq[m + 1] AS nxt, count(*) AS n FROM pr WHERE track_id % 10 < 7 AND len(seq) > m GROUP BY 1, 2), be AS (SELECT prefix, arg_min(nxt, (-n, nxt)) AS pred, CAST(sum(n) AS BIGINT) AS votes FROM tr GROUP BY 1 HAVING sum(n) >= 3) SELECT track_id, m, votes, pred FROM (SELECT pr.track_id, m, votes, pred, row_number() OVER (PARTITION BY pr.track_id ORDER BY m DESC) AS k FROM pr JOIN be USING (prefix) WHERE pr.track_id % 10 >= 7) WHERE k = 1")
def _(t):
    s = sequences(t.fx_r)
    return retrieve_next(s.where("track_id % 10 >= 7"), s.where("track_id % 10 < 7"))


@query("route_representative", f"WITH {SEQS_SQL}, r AS (SELECT DISTINCT track_id, route_id FROM fx_r WHERE track_id % 10 < 7), n AS (SELECT route_id, array_to_string(seq, ',') AS seq, count(*) AS n FROM sq JOIN r USING (track_id) GROUP BY 1, 2) SELECT route_id, arg_min(seq, (-n, seq)) AS seq, max(n) AS n FROM n GROUP BY 1")
def _(t):
    r = t.fx_r.where("track_id % 10 < 7")
    s = sequences(r).withColumn("seq", F.array_join("seq", ",")).join(r.select("track_id", "route_id").distinct(), "track_id")
    return most_frequent(s, ["route_id"], "seq")


def fit_normalizers(rows: DataFrame, keys: list[str], features: list[str], tails: tuple = ()) -> DataFrame:
    """Per key mean_ and sd_ of each feature over the (train) rows, and p95_ of those in ``tails``; nulls do not count."""
    fits = [f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return rows.groupBy(*keys).agg(*fits, *(F.percentile(c, 0.95).alias(f"p95_{c}") for c in tails))


@query("fit_normalizers", f"""WITH {STEPS_SQL}, d AS (SELECT scene, round(avg(dur), 4) AS mean_dur, round(stddev_pop(dur), 4) AS sd_dur, round(quantile_cont(dur, 95e-2), 4) AS p95_dur FROM st WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY scene),
g AS (SELECT scene, round(avg(lat), 4) AS mean_lat, round(stddev_pop(lat), 4) AS sd_lat, round(avg(lon), 4) AS mean_lon, round(stddev_pop(lon), 4) AS sd_lon, round(avg(ele), 4) AS mean_ele, round(stddev_pop(ele), 4) AS sd_ele FROM fx_p WHERE track_id % 10 < 7 GROUP BY scene),
e AS (SELECT scene, round(avg(up_m), 4) AS mean_up_m, round(stddev_pop(up_m), 4) AS sd_up_m, round(avg(mean_grade), 4) AS mean_mean_grade, round(stddev_pop(mean_grade), 4) AS sd_mean_grade FROM fx_s WHERE track % 10 < 7 GROUP BY scene)
SELECT * FROM d LEFT JOIN g USING (scene) LEFT JOIN e USING (scene)""")
def _(t):
    times = fit_normalizers(steps(t.fx_r).where("nxt is not null and track_id % 10 < 7"), ["scene"], ["dur"], ("dur",))
    places = fit_normalizers(t.fx_p.where("track_id % 10 < 7"), ["scene"], ["lat", "lon", "ele"])
    ways = fit_normalizers(t.fx_s.where("track % 10 < 7"), ["scene"], ["up_m", "mean_grade"])
    out = times.join(places, "scene", "left").join(ways, "scene", "left")
    return out.select("scene", *(F.round(c, 4).alias(c) for c in out.columns if c != "scene"))


def markov_rollout(test: DataFrame, train: DataFrame, prefix: int = 2) -> DataFrame:
    """(track_id, pos, pred) for every position after ``prefix`` up to each track's length: predictions are fed back.

    The successor of each region is worked out once; squared again and again it gives jumps of 1, 2, 4, .. steps, and each
    position is reached by the jumps that its distance is made of. So the rounds grow with the logarithm of the longest track.
    """
    start = test.where(F.col("pos") == prefix).select("track_id", F.col("region_id").alias("at"))
    length = test.groupBy("track_id").agg(F.max("pos").alias("len")).where(F.col("len") > prefix)
    moves = train.where("nxt is not null")
    regions = moves.select("region_id").union(moves.select("nxt")).union(start.select("at")).distinct()
    jump = stored(markov_next(regions, train).select(F.col("region_id").alias("_x"), F.col("pred").alias("_y")))
    longest = length.agg(F.max("len")).first()[0] or prefix
    out = start.join(length, "track_id").select("track_id", F.explode(F.sequence(F.lit(1), F.col("len") - prefix)).alias("_k"), "at")
    for b in range((longest - prefix).bit_length()):
        out = out.join(jump, F.col("at") == F.col("_x"), "left").select("track_id", "_k", F.when(F.col("_k").bitwiseAND(F.lit(1 << b)) != 0, F.col("_y")).otherwise(F.col("at")).alias("at"))
        jump = stored(jump.join(jump.select(F.col("_x").alias("_y"), F.col("_y").alias("_z")), "_y").select("_x", F.col("_z").alias("_y")))
    return out.select("track_id", (F.col("_k") + prefix).alias("pos"), F.col("at").alias("pred"))


@query("markov_rollout", f"WITH RECURSIVE {MARKOV_SQL}, ln AS (SELECT track_id, max(pos) AS n FROM st GROUP BY 1), ro AS (SELECT track_id, pos, region_id AS cur FROM st WHERE pos = 2 AND track_id % 10 >= 7 UNION ALL SELECT ro.track_id, CAST(ro.pos + 1 AS INT), coalesce(mk.pred, gb.best) FROM ro JOIN ln ON ln.track_id = ro.track_id LEFT JOIN mk ON mk.region_id = ro.cur CROSS JOIN gb WHERE ro.pos < ln.n) SELECT track_id, pos, cur AS pred FROM ro WHERE pos > 2")
def _(t):
    s = stored(steps(t.fx_r).select("track_id", "pos", "region_id", "nxt"))  # read five times
    return markov_rollout(s.where("track_id % 10 >= 7"), s.where("track_id % 10 < 7"))


@query("track_alignment", "WITH p AS (SELECT track_id, pos, pred_next FROM fx_pred WHERE track_id % 3 > 0) SELECT r.scene, count(*) AS n, round(avg(CASE WHEN p.pred_next = r.true_next THEN 1e0 ELSE 0e0 END), 6) AS hit FROM fx_pred r JOIN p ON p.track_id = r.track_id AND p.pos = r.pos GROUP BY r.scene")
def _(t):
    p = t.fx_pred.where("track_id % 3 > 0").select("track_id", "pos", F.col("pred_next").alias("pred"))
    return t.fx_pred.join(p, ["track_id", "pos"]).groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("true_next")).cast("double")), 6).alias("hit"))


# Scores


@query("path_coverage", "WITH c AS (SELECT scene, pos, sum(true_dur - mu) OVER w AS e, sqrt(sum(sigma * sigma) OVER w) AS s FROM fx_pred WINDOW w AS (PARTITION BY track_id ORDER BY pos)) SELECT scene, count(*) AS n, round(avg(CASE WHEN abs(e) <= 16449e-4 * s THEN 1e0 ELSE 0e0 END), 5) AS picp90, round(avg(2 * 16449e-4 * s) / 60, 4) AS width_min FROM c WHERE s IS NOT NULL GROUP BY scene")
def _(t):
    w = Window.partitionBy("track_id").orderBy("pos")
    c = t.fx_pred.select("scene", F.sum(F.col("true_dur") - F.col("mu")).over(w).alias("e"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma")).over(w)).alias("s")).where("s is not null")
    return c.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg((F.abs("e") <= 1.6449 * F.col("s")).cast("double")), 5).alias("picp90"), F.round(F.avg(2 * 1.6449 * F.col("s")) / 60, 4).alias("width_min"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r of the rows that have both; NaN where a side is constant, for which corr raises a division by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


@query("residual_correlation", "WITH z AS (SELECT track_id, pos, (true_dur - mu) / sigma AS z FROM fx_pred WHERE sigma IS NOT NULL) , c AS (SELECT a.pos AS p, b.pos AS q, corr(a.z, b.z) AS r, count(*) AS n FROM z a JOIN z b ON a.track_id = b.track_id AND a.pos < b.pos GROUP BY 1, 2 HAVING count(*) >= 10) SELECT p, q, round(r, 6) AS r, n, round(avg(abs(r)) OVER (), 6) AS mean_abs, round(avg(CASE WHEN q = p + 1 THEN abs(r) END) OVER (), 6) AS mean_adjacent FROM c")
def _(t):
    z = t.fx_pred.where("sigma is not null").select("track_id", "pos", ((F.col("true_dur") - F.col("mu")) / F.col("sigma")).alias("z"))
    pairs = z.select("track_id", F.col("pos").alias("p"), F.col("z").alias("x")).join(z.select("track_id", F.col("pos").alias("q"), F.col("z").alias("y")), "track_id").where("p < q")
    c = pairs.groupBy("p", "q").agg(correlation("x", "y").alias("r"), F.count("*").alias("n")).where("n >= 10")
    all_ = Window.partitionBy(F.lit(1))  # a row for each pair of positions
    mean = lambda x: F.round(F.avg(x).over(all_), 6)
    return c.select("p", "q", F.round("r", 6).alias("r"), "n", mean(F.abs("r")).alias("mean_abs"), mean(F.when(F.col("q") == F.col("p") + 1, F.abs("r"))).alias("mean_adjacent"))


def cluster_agreement(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic) and Fowlkes-Mallows in one row, from the table
    of label pairs; NULL under 10 rows or with one label on a side. Rows without a label are left out."""
    n = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("a"), F.col(pred).alias("b")).agg(F.count("*").cast("double").alias("n"))
    marked = n.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    pairs = lambda c: c * (c - 1) / 2
    total = F.sum("n")
    s = marked.agg(total.alias("t"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"), F.sum(pairs(F.col("n"))).alias("same"), F.sum(F.col("n") / F.col("na") * pairs(F.col("na"))).alias("pa"), F.sum(F.col("n") / F.col("nb") * pairs(F.col("nb"))).alias("pb"), F.sum(F.col("n") * F.ln(F.col("n") / F.col("na") / F.col("nb"))).alias("l"), F.sum(F.col("n") * F.ln("na")).alias("la"), F.sum(F.col("n") * F.ln("nb")).alias("lb"))
    expected = F.col("pa") * F.col("pb") / pairs(F.col("t"))
    mutual, ha, hb = F.col("l") / F.col("t") + F.ln("t"), F.ln("t") - F.col("la") / F.col("t"), F.ln("t") - F.col("lb") / F.col("t")
    enough = (F.col("t") >= 10) & (F.col("ka") >= 2) & (F.col("kb") >= 2)
    return s.select(F.when(enough, (F.col("same") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("ari"), F.when(enough, 2 * mutual / (ha + hb)).alias("nmi"), F.when(enough, F.col("same") / F.sqrt(F.col("pa") * F.col("pb"))).alias("fm"))


@query("cluster_agreement", """WITH n AS (SELECT true_next AS a, pred_next AS b, CAST(count(*) AS DOUBLE) AS n FROM fx_pred GROUP BY 1, 2),
a AS (SELECT sum(n) AS n FROM n GROUP BY a), b AS (SELECT sum(n) AS n FROM n GROUP BY b),
s AS (SELECT (SELECT sum(n) FROM n) AS t, (SELECT sum(n * (n - 1) / 2) FROM n) AS same, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb),
h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, s) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, s) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM n, s) AS hab)
SELECT round((same - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi, round(same / sqrt(pa * pb), 6) AS fm FROM s, h""")
def _(t):
    s = cluster_agreement(t.fx_pred, "true_next", "pred_next")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("purity_coverage", "WITH n AS (SELECT pred_next AS c, true_next AS y, count(*) AS n FROM fx_pred GROUP BY 1, 2), m AS (SELECT c, arg_min(y, (-n, y)) AS y, max(n) AS n FROM n GROUP BY c) SELECT round(sum(n) / (SELECT sum(n) FROM n), 6) AS purity, round(count(DISTINCT y) / (SELECT count(DISTINCT y) FROM n), 6) AS coverage FROM m")
def _(t):
    return purity_coverage(t.fx_pred, "pred_next", "true_next").select(F.round("purity", 6).alias("purity"), F.round("coverage", 6).alias("coverage"))


def purity_coverage(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """One row: share of rows in their cluster's majority class, and share of classes that are a majority somewhere."""
    n = df.groupBy(cluster, truth).agg(F.count("*").alias("_n"))
    best = n.groupBy(cluster).agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(truth).alias("y"))).alias("_b")).agg((-F.sum("_b.k")).alias("hit"), F.countDistinct("_b.y").alias("seen"))
    return best.crossJoin(n.agg(F.sum("_n").alias("all"), F.countDistinct(truth).alias("classes"))).select((F.col("hit") / F.col("all")).alias("purity"), (F.col("seen") / F.col("classes")).alias("coverage"))


# Rank statistics over result tables


def average_rank(c: str) -> Column:
    """Rank of a value among all rows, ties sharing their mean; for result tables, not for data."""
    return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2


SCENES_SQL = "sc AS (SELECT target, avg(CASE WHEN grp = 'full' THEN mae_min END) AS x, avg(CASE WHEN grp = 'no_slope' THEN mae_min END) AS y, CAST(sum(n_seg) AS DOUBLE) AS z FROM fx_res GROUP BY target), rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in "xyz") + " FROM sc), co AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM rk)"


def scene_values(results: DataFrame) -> DataFrame:
    """(target, x, y, z): mean error of either group, and segments, by scene."""
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("mae_min")))
    return results.groupBy("target").agg(mean("full").alias("x"), mean("no_slope").alias("y"), F.sum("n_seg").cast("double").alias("z"))


def rank_correlations(df: DataFrame) -> DataFrame:
    """One row xy, xz, yz of rank correlations of columns x, y, z."""
    r = df.select(*(average_rank(c).alias(c) for c in "xyz"))
    return r.agg(correlation("x", "y").alias("xy"), correlation("x", "z").alias("xz"), correlation("y", "z").alias("yz"))


DRAWS_SQL = """, vr AS (SELECT x, y, row_number() OVER (ORDER BY target) - 1 AS k, count(*) OVER () AS n FROM (SELECT target, avg(CASE WHEN grp = 'full' THEN mae_min END) AS x, avg(CASE WHEN grp = 'no_slope' THEN mae_min END) AS y FROM fx_res GROUP BY target)),
sp AS (SELECT draw, i, CAST('0x' || substr(md5('42|' || draw || '|' || i), 1, 8) AS BIGINT) % n AS k FROM (SELECT max(n) AS n FROM vr) CROSS JOIN (SELECT unnest(range(2000)) AS draw) CROSS JOIN (SELECT unnest(range(1, 1000)) AS i) WHERE i <= n),
bk AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2e0 AS x, rank() OVER (PARTITION BY draw ORDER BY y) + (count(*) OVER (PARTITION BY draw, y) - 1) / 2e0 AS y FROM sp JOIN vr USING (k)),
bs AS (SELECT quantile_cont(rho, 25e-3) AS low, quantile_cont(rho, 975e-3) AS high FROM (SELECT draw, corr(x, y) AS rho FROM bk GROUP BY 1))"""


@query("spearman_bootstrap", f"WITH {SCENES_SQL}{DRAWS_SQL} SELECT round(xy, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high FROM co CROSS JOIN bs")
def _(t):
    values = scene_values(t.fx_res)
    rho = rank_correlations(values).select(F.round("xy", 6).alias("rho"))
    return rho.crossJoin(spearman_interval(values, "target").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high")))  # one row each


def spearman_interval(df: DataFrame, key: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(low, high): percentile interval of the rank correlation of x and y over ``draws`` resamples, picked by hash."""
    rows = df.select("x", "y", (F.row_number().over(Window.orderBy(key)) - 1).alias("k"))  # a result table
    n = rows.agg(F.count("*").alias("n"))
    spots = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(n).withColumn("i", F.explode(F.expr("sequence(1, cast(n as int))")))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "i")), 1, 8), 16, 10).cast("long")
    picked = spots.withColumn("k", pick % F.col("n")).join(rows, "k")
    rank = lambda c: F.rank().over(Window.partitionBy("draw").orderBy(c)) + (F.count("*").over(Window.partitionBy("draw", c)) - 1) / 2
    rho = picked.select("draw", rank("x").alias("x"), rank("y").alias("y")).groupBy("draw").agg(correlation("x", "y").alias("rho"))
    return rho.agg(F.percentile("rho", 0.025).alias("low"), F.percentile("rho", 0.975).alias("high"))


@query("partial_spearman", f"WITH {SCENES_SQL} SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS rho FROM co")
def _(t):
    xy, xz, yz = (F.col(c) for c in ("xy", "xz", "yz"))
    return rank_correlations(scene_values(t.fx_res)).select(F.round((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz)), 6).alias("rho"))


@query("gain_by_scene", "SELECT target, round(avg(CASE WHEN seed < 2 THEN mae_min END) - avg(CASE WHEN seed >= 2 THEN mae_min END), 5) AS gain FROM fx_res WHERE grp = 'full' GROUP BY target")
def _(t):
    part = lambda c: F.avg(F.when(c, F.col("mae_min")))
    return t.fx_res.where("grp = 'full'").groupBy("target").agg(F.round(part(F.col("seed") < 2) - part(F.col("seed") >= 2), 5).alias("gain"))


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """(n, w, p) of the signed-rank test on column d, zeros dropped: w the smaller rank sum; p two-sided,
    by counting rank sums (doubled, so that tied ranks count too) up to 50 rows, else by the normal curve."""
    ranks = signed_ranks(diffs)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, w, doubled in zip(batch.n, batch.w, batch.ranks):
                ways = {0: 1}
                for r in doubled:
                    new = dict(ways)
                    for s, c in ways.items():
                        new[s + int(r)] = new.get(s + int(r), 0) + c
                    ways = new
                out.append((n, w, min(1.0, 2 * sum(c for s, c in ways.items() if s <= 2 * w) / 2**n)))
            yield pd.DataFrame(out, columns=["n", "w", "p"])

    rank2 = (2 * F.col("r")).cast("int")
    s = ranks.agg(F.count("*").alias("n"), F.least(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))).alias("w"), F.sum(F.col("r") * F.col("r")).alias("v"), F.count("*").alias("_n"))
    few = s.where("n between 1 and 50").crossJoin(ranks.agg(F.slice(F.collect_list(rank2), 1, 51).alias("ranks")))
    many = s.where("n > 50").withColumn("p", F.least(F.lit(1.0), 2 * normal_cdf((F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("v") / 4))))
    return few.select("n", "w", "ranks").mapInPandas(exact, "n long, w double, p double").unionByName(many.select("n", "w", "p"))


@query("wilcoxon_signed_rank", f"""WITH RECURSIVE {PAIRS_SQL}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM sd WHERE d <> 0) , s AS (SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0e0 END), sum(CASE WHEN d < 0 THEN r ELSE 0e0 END)) AS w FROM r),
k AS (SELECT CAST(2 * r AS INT) AS r, row_number() OVER (ORDER BY r) AS i FROM r), u AS (SELECT 0 AS i, 0 AS s, CAST(1 AS DOUBLE) AS c UNION ALL SELECT g.i, g.s, sum(g.c) FROM (SELECT u.i + 1 AS i, u.s + e.b * k.r AS s, u.c FROM u JOIN k ON k.i = u.i + 1 CROSS JOIN (VALUES (0), (1)) AS e(b)) g GROUP BY 1, 2)
SELECT s.n, s.w, round(least(1e0, (SELECT 2 * sum(c) FROM u, s WHERE u.i = s.n AND u.s <= 2 * s.w) / pow(2e0, s.n)), 9) AS p FROM s""")
def _(t):
    return wilcoxon(paired_differences(t.fx_res, "no_slope", "full")).withColumn("p", F.round("p", 9))
