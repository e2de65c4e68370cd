"""Tables in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_ROWS = 100_000  # that a task of a learner holds


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """A stored table in parts of about ``rows`` rows, by a hash of the whole row and in its order: a learner holds a task's rows with
    their bins and samples of all trees, which files do not bound. The parts do not hang on how the table was written."""
    parts = max(1, -(-df.count() // rows))
    key = F.xxhash64(*df.columns)
    return df.repartition(parts, key).sortWithinPartitions(key, *df.columns)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long) as (node, component), component
    being the smallest node that can be reached. Nodes without an edge are not listed.

    Alternating large-star and small-star steps: each round is two aggregations and two joins, the
    number of edges never grows, and a path of n nodes needs about log n rounds. Each round's edges
    are written to the shared folder, so an executor's loss repeats one round at most. Nulls and
    loops are ignored.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _fingerprint(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(new)
        discard(now)
        now = new
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
