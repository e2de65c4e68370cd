"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekspark.llm.common import read_table, stored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_TOKENS = 32
SHARD_TOKENS = 2_000_000
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target): ``share`` times all words dealt by weight, the weights
    repeating over the sources in code point order (null last); a target stops at ``repeats`` times
    the source's words, and the rest is dealt again by weight until none is above.

    Solved in one pass: sources in order of cap / weight; a source is capped if the level that the
    others before it leave is at least its own ratio. The windows here run over one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    s = per_source.select("source", "source_size", F.row_number().over(w).alias("rank"), weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("cap"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * share
    room = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.select("*", total.alias("total"), (room * F.col("weight") >= F.col("cap") * rest).alias("capped"))
    level = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)) / F.nullif(F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every), F.lit(0.0))
    target = F.round(F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")), 6)
    return s.select("source", "rank", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, group: list[str], order: list[str]) -> DataFrame:
    """``parties`` with quota long: within each ``group``, ``seats`` (one value a group) go one by one
    to the highest quotient votes / (2 * held + 1), ties to the first in ``order``.

    The divisor bounds of the method give each party a number of seats that it holds for certain, and
    leave at most three quotients or so a party to be ranked, however many seats there are.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(g).cast("double")).withColumn("_n", F.count(F.lit(1)).over(g))
    ideal = lambda k: F.coalesce(F.col(votes) * (F.col("_seats") + F.col("_n") * k) / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0))
    p = p.withColumn("_low", F.greatest(F.floor(ideal(-0.5) + 0.5 - 1e-9), F.lit(0)).cast("long")).withColumn("_high", F.ceil(ideal(0.5) + 0.5).cast("long"))
    p = p.withColumn("_open", F.col("_seats") - F.sum("_low").over(g))
    asked = p.select("*", F.explode(F.sequence(F.col("_low") + 1, F.col("_high") + 1)).alias("_nth"))
    by = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_nth") - 1)).desc(), *order, "_nth")
    won = asked.withColumn("_won", (F.row_number().over(by) <= F.col("_open")) & (F.col(votes) > 0))
    return won.groupBy(*parties.columns).agg((F.first("_low") + F.count_if("_won")).alias("quota"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, and how they
    come about: passes (times that the whole document is taken) and two word ranges of it,
    [from_1, to_1) and [from_2, to_2), taken once more.

    Blocks of ``block_tokens`` words are apportioned to sources by target, then to each source's
    shards by words; a shard holds about ``shard_tokens`` words, so no source, however large, meets
    in one task. A shard's documents stand in seeded order on a ring of blocks; whole rounds are
    taken first, then the quota's rest from a seeded block on. Null text: size 0. Documents of size 0
    take 0. A null source is a source. Rows that are alike in doc_id and size are interchangeable. An empty table gives an empty
    result; other columns of ``docs`` are not read.
    """
    sized = stored(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    sources = stored(source_targets(sized, weights, share, repeats))
    of_all = Window.partitionBy()
    seats = F.round(F.sum("target").over(of_all) / block_tokens)
    one = sources.where("target > 0").withColumn("_one", F.lit(1)).withColumn("seats", seats)
    quotas = sainte_lague(one, "target", F.col("seats"), ["_one"], ["rank"]).select("rank", "quota")
    known = stored(sources.join(quotas, "rank", "left").select("source", "rank", "source_size", "target", F.coalesce("quota", F.lit(0)).alias("source_quota")))

    placed = sized.join(known, sized.source.eqNullSafe(known.source)).drop(known.source)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("long")
    dealt = placed.where("size > 0").withColumn("order", key).withColumn("shard", F.conv(F.substring("order", 1, 15), 16, 10).cast("long") % shards)
    per_shard = dealt.groupBy("rank", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    ring = F.ceil(F.col("shard_size") / block_tokens).cast("long")
    seeded = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rank", "shard")), 1, 15), 16, 10).cast("long")
    chosen = (
        sainte_lague(per_shard, "shard_size", F.col("source_quota"), ["rank"], ["shard"])
        .select("rank", "shard", ring.alias("ring"), F.least("quota", ring * repeats).alias("quota"))
        .select("rank", "shard", "ring", F.expr("quota div ring").alias("passes"), (F.col("quota") % F.col("ring")).alias("blocks"), (seeded % F.col("ring")).alias("first"))
        .select("rank", "shard", "passes", (F.col("first") * block_tokens).alias("start"), ((F.col("first") + F.col("blocks")) * block_tokens).alias("stop"), (F.col("ring") * block_tokens).alias("round"))
    )
    run = Window.partitionBy("rank", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = dealt.withColumn("at", F.coalesce(F.sum("size").over(run), F.lit(0))).join(chosen, ["rank", "shard"])
    within = lambda x: F.least(F.greatest(x - F.col("at"), F.lit(0)), F.col("size"))
    cut = at.select("doc_id", "source", "size", "source_size", "target", "passes", within(F.col("start")).alias("from_1"), within(F.col("stop")).alias("to_1"), F.lit(0).cast("long").alias("from_2"), within(F.col("stop") - F.col("round")).alias("to_2"))
    none = placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target", *(F.lit(0).cast("long").alias(c) for c in ("passes", "from_1", "to_1", "from_2", "to_2")))
    taken = F.col("passes") * F.col("size") + (F.col("to_1") - F.col("from_1")) + (F.col("to_2") - F.col("from_2"))
    return cut.unionByName(none).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "from_1", "to_1", "from_2", "to_2")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole pass, and one for each further range of
    words (with the white space between them). text and n_chars change, other columns stay."""
    plan = mix(docs, **options)
    by = Window.partitionBy("doc_id").orderBy("source", "size")
    used = plan.withColumn("_nth", F.row_number().over(by)).where("passes > 0 or to_1 > from_1 or to_2 > from_2")
    used = used.select(F.col("doc_id").alias("_id"), F.col("_nth").alias("_n"), *(F.col(c).alias(f"_{c}") for c in ("size", "passes", "from_1", "to_1", "from_2", "to_2")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    rows = docs.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", size)))
    both = rows.join(used, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_n")))
    span = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("_size").alias("b")), F.col("_passes").cast("int"))
    parts = F.filter(F.concat(whole, F.array(span("_from_1", "_to_1"), span("_from_2", "_to_2"))), lambda x: x.b > x.a)
    cut = both.withColumn("_part", F.explode(parts))
    words = F.split(F.regexp_replace("text", f"^{SPACE}+", ""), f"(?<={SPACE})(?={WORD[:-1]})")
    text = F.when((F.col("_part.a") == 0) & (F.col("_part.b") == F.col("_size")), F.col("text")).otherwise(F.array_join(F.slice(words, (F.col("_part.a") + 1).cast("int"), (F.col("_part.b") - F.col("_part.a")).cast("int")), ""))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The same mix: every quotient of every seat is ranked, and targets come from the level of the uncapped sources.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) AS BIGINT) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS cap, sum(source_size) OVER () * 1.5e0 AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0e0)) * weight >= cap * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS capped FROM s2 WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, rank, source_size, round(CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0e0 END) OVER ()) / nullif(sum(CASE WHEN capped THEN 0e0 ELSE weight END) OVER (), 0e0) * weight END, 6) AS target FROM s3),
k AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS seats FROM s4 WHERE target > 0),
q0 AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, rank, j) AS place FROM s4, k, unnest(range(1, k.seats + 1)) AS u(j) WHERE target > 0),
q AS (SELECT rank, count(*) AS quota FROM q0, k WHERE place <= seats GROUP BY rank),
p AS (SELECT d.doc_id, d.size, s4.*, coalesce(q.quota, 0) AS source_quota, md5('mix-1|' || CAST(d.doc_id AS VARCHAR)) AS mixed, greatest(CAST(ceil(source_size / 2e6) AS BIGINT), 1) AS shards FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN q ON q.rank = s4.rank),
w AS (SELECT *, CAST('0x' || substr(mixed, 1, 15) AS BIGINT) % shards AS shard FROM p WHERE size > 0),
h AS (SELECT rank, shard, source_quota, CAST(sum(size) AS BIGINT) AS shard_size FROM w GROUP BY 1, 2, 3),
h0 AS (SELECT rank, shard, source_quota, row_number() OVER (PARTITION BY rank ORDER BY CAST(shard_size AS DOUBLE) / (2 * j - 1) DESC, shard, j) AS place FROM h, unnest(range(1, h.source_quota + 1)) AS u(j)),
h1 AS (SELECT rank, shard, count(*) AS quota FROM h0 WHERE place <= source_quota GROUP BY 1, 2),
r AS (SELECT h.rank, h.shard, CAST(ceil(shard_size / 32e0) AS BIGINT) AS ring, least(coalesce(quota, 0), 2 * CAST(ceil(shard_size / 32e0) AS BIGINT)) AS quota FROM h LEFT JOIN h1 ON h1.rank = h.rank AND h1.shard = h.shard),
c AS (SELECT rank, shard, quota // ring AS passes, quota % ring AS blocks, ring * 32 AS whole, CAST('0x' || substr(md5('mix-1|' || CAST(rank AS VARCHAR) || '|' || CAST(shard AS VARCHAR)), 1, 15) AS BIGINT) % ring AS block0 FROM r),
a AS (SELECT w.*, passes, whole, block0 * 32 AS from0, (block0 + blocks) * 32 AS to0, CAST(coalesce(sum(size) OVER (PARTITION BY w.rank, w.shard ORDER BY mixed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos0 FROM w JOIN c ON c.rank = w.rank AND c.shard = w.shard)
SELECT doc_id, source, size, source_size, target, CAST(passes * size + least(greatest(to0 - pos0, 0), size) - least(greatest(from0 - pos0, 0), size) + least(greatest(to0 - whole - pos0, 0), size) AS BIGINT) AS taken FROM a
UNION ALL SELECT doc_id, source, size, source_size, target, 0 FROM p WHERE size = 0
"""
