"""URL filters: ordered host and path rules, and trust and distrust spread over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import discard, read_table, stored

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ERROR = 1e-6  # that a score may be away from its fixed point
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST = r"(?s)^(?:(?!://).)*+://"  # up to the first :// and no further
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, FIRST + r"([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, FIRST + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: str, path: str, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(length, rule, action); ties to the greater text. Rules are
    an argument of the program, a few thousand at most; they are matched in the row, with no join."""
    fits = []
    for action, rule in rules:
        rule_host, _, rest = rule.partition("/")
        at = (F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)
        fits.append(F.when(at & F.col(path).startswith("/" + rest), F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted over all pages."""
    links = pages.select(host_of("url").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    return links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, error: float = ERROR) -> DataFrame:
    """(host, score): the fixed point of score = seed + damping * (scores that arrive over edges), to within
    ``error`` of each score; each host deals its score over its edges by weight.

    The moves of a round shrink by ``damping`` at least in sum, so the rest after a round whose moves sum to m is at
    most m damping / (1 - damping): rounds go on until that is ``error`` or less. Of ``seeds`` in sum S that takes
    at most log(S / error (1 - damping)) / log(1 / damping) rounds. Empty seeds or edges take one.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    now = stored(seeds.select("host", F.col("seed").alias("score")))
    while True:
        arriving = now.join(shares, now.host == shares.src).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("arrives"))
        new = stored(seeds.join(arriving, "host", "full").join(now.select("host", F.col("score").alias("was")), "host", "left").select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("arrives", F.lit(0.0))).alias("score"), F.coalesce("was", F.lit(0.0)).alias("was")))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        discard(now)
        now = new
        if moved * damping <= error * (1 - damping):
            break
    discard(shares)
    return now.select("host", "score")


def judged(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, error: float = ERROR, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Other pages go by their host: the share of a host's pages that
    rules allow seeds trust, which follows links; the share that rules block seeds distrust, which
    runs against links, to those who link there. A host is blocked if distrust exceeds trust by
    ``threshold`` or more. Hosts that nothing reaches are allowed, as are pages with a null url or one without
    "://" (host and path empty). Links within a host do not count. Repeated rows count each; extra columns are not read.
    """
    rows = stored(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("fit", rule_for("host", "path", rules)))
    share = lambda action: F.sum(F.when(F.col("fit.action") == action, 1.0).otherwise(0.0)) / F.count("*")
    per_host = stored(rows.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    edges = stored(host_edges(pages))
    trust = personalised_rank(edges, per_host.where("allowed > 0").select("host", F.col("allowed").alias("seed")), damping, error)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(against, per_host.where("blocked > 0").select("host", F.col("blocked").alias("seed")), damping, error)
    hosts = per_host.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    both = rows.join(hosts, "host", "left").select("page_id", "host", "path", "fit", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    method = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", method).alias("verdict"), "trust", "distrust")


def op9_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "pages"))
