"""Exact similarity joins by prefix signatures: every pair that is similar shares one; links, not all pairs, come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekspark.llm.common import components, discard, gives_memory_back, stored

COUNT_BITS = 20  # slots of the table of counts
CHUNKS = 256  # parts in which a task sends its table


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def frequent(items: DataFrame, grams: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shares: tuple, least: int = 16) -> Broadcast:
    """For each slot, how many of ``shares`` (ascending) of the rows of ``items`` its count over all rows reaches, and 0 below
    ``least``: common grams get levels of 1 or more. ``grams`` gives those of a batch, in arrays.

    A table of fixed size (1 MB) for any number of rows: each task adds up its own and sends it in chunks, whose sums
    are taken batch by batch. Any order of grams is right; rare ones first makes groups small.
    """

    @gives_memory_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            n = 0
            for some in grams(batch):
                held.append(slots(some))
                n += len(some)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=1 << COUNT_BITS)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=1 << COUNT_BITS)
        rows = [(k, x.tobytes()) for k, x in enumerate(total.astype("<u4").reshape(CHUNKS, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "counts"])

    rows = items.count()
    levels = [max(least, int(share * rows)) for share in shares]
    size = (1 << COUNT_BITS) // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        for chunk, counts in sums.items():
            level = np.searchsorted(levels, counts, "right")
            at = np.flatnonzero(level)
            yield pa.RecordBatch.from_arrays([pa.array((chunk * size + at).astype(np.int32)), pa.array(level[at].astype(np.int32))], names=["slot", "level"])

    common = items.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "slot int, level int").toPandas()
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    table[common.slot] = common.level
    return items.sparkSession.sparkContext.broadcast(table)


def linked(sigs: DataFrame, may: Callable, texts: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) whose connected components are those of all similar pairs that share a gram.

    ``sigs`` (gram, hot, key, more columns): ``hot``, which follows from the gram, marks those that many keys may have,
    whose keys are not dealt to one task; repeated rows count once. ``may(x, y)`` is a condition on two structs of
    (key, more columns) that no similar pair fails; ``texts`` gives one row of each of some keys; ``verified`` takes pairs
    (a, b) and such rows, and keeps the similar ones. Each key is first compared with the smallest key of its grams,
    which links large groups in linear work; then all pairs that share a gram and are not yet in one component are
    compared, so no link is lost.
    """
    columns = [c for c in sigs.columns if c not in ("gram", "hot")]
    keyed = F.struct(*columns).alias("x")
    by_gram = Window.partitionBy("gram")
    cold = sigs.where("not hot").select("gram", *columns).repartition("gram")
    low, high = F.min("key").over(by_gram), F.max("key").over(by_gram)
    cold = cold.select("*", low.alias("low"), high.alias("high")).where("low != high").select("gram", *columns).distinct().select("gram", keyed)  # most grams have one key
    cold = cold.select("gram", "x", F.min("x").over(by_gram).alias("y"), F.count("*").over(by_gram).alias("n")).where("n > 1")
    hot = sigs.where("hot").select("gram", *columns).distinct().select("gram", keyed)
    stars = hot.groupBy("gram").agg(F.min("x").alias("y"), F.count("*").alias("n")).where("n > 1")
    shared = stored(cold.unionByName(hot.join(stars, "gram")))
    star = shared.where(F.col("x.key") != F.col("y.key")).where(may(F.col("x"), F.col("y"))).select(F.col("y.key").alias("a"), F.col("x.key").alias("b")).distinct()
    star = stored(star)
    # of a gram with two keys the star is the only pair; keys of others may be compared later
    more = shared.where("n > 2").select(F.col("x.key").alias("key"))
    of_key = stored(texts(star.select(F.explode(F.array("a", "b")).alias("key")).unionByName(more).distinct()))
    first = stored(verified(star, of_key))
    groups = stored(components(first))
    rooted = shared.where("n > 2").select("gram", "x", F.col("x.key").alias("node")).join(groups, "node", "left").select("gram", "x", F.coalesce("component", "node").alias("root"))
    mixed = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram")
    open_ = stored(rooted.join(mixed, "gram", "left_semi"))
    left, right = open_.select("gram", "x", F.col("root").alias("root_x")), open_.select("gram", F.col("x").alias("y"), F.col("root").alias("root_y"))
    apart = (F.col("root_x") < F.col("root_y")) & may(F.col("x"), F.col("y"))
    rest = left.alias("l").join(right.alias("r"), (F.col("l.gram") == F.col("r.gram")) & apart).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    rest = rest.join(star, ["a", "b"], "left_anti")
    discard(shared)
    out = stored(groups.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(verified(rest, of_key)))
    for table in (star, of_key, first, groups, open_):
        discard(table)
    return out
