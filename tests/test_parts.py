"""Parts of learners' tables: bounded by rows, whatever the files, and the same however rows were written."""

from pyspark.sql import functions as F

from trekspark.graph import dealt, stored


def test_parts_grow_in_number_not_in_size(spark):
    for n in (0, 1, 3_000, 12_000):
        table = stored(spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("x")).coalesce(1))
        parts = dealt(table, 500)
        sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes, default=0) < 800
        again = dealt(stored(table.repartition(3, "x")), 500)
        place = F.struct("id", "x", F.spark_partition_id())
        assert parts.select(place).exceptAll(again.select(place)).isEmpty()
