"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import components, discard, gives_memory_back, read_table, stored, with_columns
from trekspark.llm.prefix_join import frequent, linked, slots

BITS = 64
TABLE_BITS = 16  # buckets of the count table of one partition
SHARES = (3e-3, 1e-2, 3e-2, 1e-1)  # of all documents: levels of how common a shingle is


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash: bit b is set if it is set in over half of the XXH64 values (seed 42) of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashed, shingles = xxhash.xxh64_intdigest, len(words) - words_per_shingle + 1
    ones = np.zeros(BITS, np.int64)
    for first in range(0, shingles, 1 << 16):
        last = min(shingles, first + (1 << 16))
        h = np.fromiter((hashed(joined[a : b - 1], 42) for a, b in zip(starts[first:last], ends[first + words_per_shingle - 1 :])), "<u8", last - first)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null and empty texts have fingerprint 0."""

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((signed(fingerprint(t.as_py(), words_per_shingle)) for t in batch.column("text")), "i8", batch.num_rows)
            yield with_columns(batch, {"fp": pa.array(fp)}, drop=("text",))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def correlated_partitions(ones: np.ndarray, both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Group the 64 bits so that correlated bits share a partition: grow each partition from the most
    correlated free pair, adding the bit with the highest mean correlation to it."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        a, b = np.unravel_index(np.argmax(corr[np.ix_(rest, rest)]), (len(rest), len(rest)))
        group = [rest[a]] if a == b else [rest[a], rest[b]]
        while len(group) < size:
            rest = [x for x in sorted(free) if x not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        out.append(sorted(group))
        free -= set(group)
    return out


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def slot(value: np.ndarray) -> np.ndarray:
    """Place of a partition value in the count table."""
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], np.uint64)


def allocate(cost: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds that sum to radius - parts + 1 at the least total cost, for each row.

    cost[row, part, t + 1] is the estimated work of threshold t, from -1 (partition unused) to radius.
    Dynamic programming over the partitions; returns (thresholds[row, part], total cost[row]).
    """
    rows, parts, choices = cost.shape
    goal = radius - parts + 1 + parts  # thresholds shifted by one are 0 .. radius + 1
    best = np.full((rows, goal + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((parts, rows, goal + 1), np.int8)
    for k in range(parts):
        after = np.full((rows, goal + 1), np.inf)
        for t in range(min(choices, goal + 1)):
            tried = best[:, : goal + 1 - t] + cost[:, k, t, None]
            better = tried < after[:, t:]
            after[:, t:][better] = tried[better]
            picks[k][:, t:][better] = t
        best = after
    left, out = np.full(rows, goal), np.zeros((rows, parts), np.int8)
    for k in reversed(range(parts)):
        out[:, k] = picks[k][np.arange(rows), left] - 1
        left = left - out[:, k] - 1
    return out, best[:, goal]


def links(distinct: DataFrame, radius: int = 2, parts: int = 3) -> DataFrame:
    """All pairs (a, b) of the distinct 64-bit values ``fp`` that differ in 1 to ``radius`` bits.

    Generalised pigeonhole: if two values differ in at most ``radius`` bits and thresholds t_i sum to
    radius - parts + 1, then some partition i differs in at most t_i bits. Each value probes the
    exact partition values within its own thresholds, which dynamic programming picks by the number
    of candidates that a count table of fixed size foresees; so a crowded partition gets -1 (no probe).
    Where every allocation would cost more than probing the whole value (2,081 masks at radius 2),
    that is done, which bounds the work of one value however crowded its surroundings are.
    """
    stats = distinct.mapInPandas(_bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    rows = stats.toPandas()  # 64 x 64 sums
    both[rows.i, rows.j] = rows.n
    n = distinct.count()
    groups = correlated_partitions(np.diag(both).copy(), both, n, parts)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, 1 << TABLE_BITS), np.int64)
        for batch in batches:
            fp = batch.fp.to_numpy().view(np.uint64)
            for k, bits in enumerate(groups):
                total[k] += np.bincount(slot(part_value(fp, bits)), minlength=1 << TABLE_BITS)
        k, s = np.nonzero(total)
        yield pd.DataFrame({"part": k.astype(np.int32), "slot": s.astype(np.int32), "n": total[k, s]})

    table = np.zeros((parts, 1 << TABLE_BITS))
    rows = distinct.mapInPandas(tables, "part int, slot int, n long").groupBy("part", "slot").agg(F.sum("n").alias("n")).toPandas()
    table[rows.part, rows.slot] = rows.n  # parts x 65,536 sums at most
    shared = distinct.sparkSession.sparkContext.broadcast(table)
    whole = flips(BITS, radius)

    @gives_memory_back
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch.fp.to_numpy().view(np.uint64)
            for k in range(parts + 1):
                v = part_value(fp, groups[k]) if k < parts else fp
                yield pd.DataFrame({"part": np.full(len(fp), k, np.int32), "value": v.view(np.int64), "y": fp.view(np.int64)})

    @gives_memory_back
    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            for first in range(0, len(batch), 2048):
                fp = batch.fp.to_numpy()[first : first + 2048].view(np.uint64)
                values = [part_value(fp, bits) for bits in groups]
                cost = np.zeros((len(fp), parts, radius + 2))
                for k, bits in enumerate(groups):
                    for t in range(radius + 1):
                        masks = flips(len(bits), t)
                        seen = flips(len(bits), min(t, 1))
                        near = counts[k][slot((values[k][:, None] ^ seen).ravel())].reshape(len(fp), -1).sum(axis=1)
                        cost[:, k, t + 1] = near + (len(masks) - len(seen)) * counts[k].mean() + len(masks)
                at, total = allocate(cost, radius)
                all_bits = total > len(whole)
                for k in range(parts):
                    for t in range(radius + 1):
                        rows = np.flatnonzero((at[:, k] == t) & ~all_bits)
                        if len(rows):
                            masks = flips(len(groups[k]), t)
                            yield _rows(k, values[k][rows], fp[rows], masks)
                if all_bits.any():
                    yield _rows(parts, fp[all_bits], fp[all_bits], whole)

    asked = distinct.mapInPandas(probes, "part int, value long, x long")
    given = distinct.mapInPandas(index, "part int, value long, y long")
    close = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    found = asked.alias("q").join(given.alias("d"), (F.col("q.part") == F.col("d.part")) & (F.col("q.value") == F.col("d.value")) & close)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _rows(part: int, values: np.ndarray, fp: np.ndarray, masks: np.ndarray) -> pd.DataFrame:
    probed = (values[:, None] ^ masks).ravel()
    return pd.DataFrame({"part": np.full(len(probed), part, np.int32), "value": probed.view(np.int64), "x": np.repeat(fp, len(masks)).view(np.int64)})


def _bit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        for first in range(0, len(batch), 1 << 14):
            fp = np.ascontiguousarray(batch.fp.to_numpy()[first : first + (1 << 14)])
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
    i, j = np.indices(total.shape)
    yield pd.DataFrame({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "n": total.ravel().astype(np.int64)})


def near_duplicates(docs: DataFrame, radius: int = 2, parts: int = 3, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id, kept boolean (doc_id = component_id).

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id that links reach. Null and empty texts share fingerprint 0. Repeated rows stay. A
    null id takes part in links but never names a component (component_id is null where no other id
    is there). An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = stored(fingerprints(docs, words_per_shingle, id_col, text_col))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(classes.select("fp"), radius, parts))
    rooted = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Rows of ``docs``, one of each group of near-duplicates (the smallest doc_id; of repeated rows
    of that id, one). Rows without an id cannot be named as a duplicate and stay."""
    kept = near_duplicates(docs, radius).where("kept").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.select(docs.columns).unionByName(docs.where("doc_id is null"))


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole text where it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    n = max(1, len(words) - words_per_shingle + 1)
    joined = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words_per_shingle, len(words))):  # each word's hash in its place
            joined = (joined ^ (joined >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        joined = (joined ^ (joined >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(joined ^ (joined >> np.uint64(31)))


def keep_one_similar(docs: DataFrame, least: float = 0.8, words_per_shingle: int = 5, radius: int = 2, parts: int = 3) -> DataFrame:
    """Rows of ``docs``, one of each group of documents that are linked by SimHashes that differ in at most ``radius`` bits or by
    a Jaccard similarity of shingles of ``least`` or more (the smallest doc_id; of repeated rows of that id, one). Rows without an id stay.

    Fingerprints meet as in ``links``, and all that are near are linked. Documents similar by ``least`` may differ in far more
    bits, so they meet by shingles too, and none is missed: of n shingles in one global order, the first n - least n + 1 hold one that
    both documents have among theirs. These candidates are compared exactly. Null and empty texts are copies of each other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    @gives_memory_back
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column("text"))
            key = [signed(xxhash.xxh3_64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()))) for t in texts]
            yield with_columns(batch, {"key": pa.array(key, pa.int64())})

    keyed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(keys, f"doc_id {kind}, text string, key long")
    classes = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("first_id")))
    texts = stored(keyed.select("key", "text").dropDuplicates(["key"]))

    def grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (shingle_set(t.as_py(), words_per_shingle) for t in batch.column("text"))

    shared = frequent(texts.select("text"), grams, SHARES)

    @gives_memory_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                yield signed_rows(batch.slice(first, 1024))

    def signed_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, size = [], []
        for have in grams(batch):
            order = np.argsort(shared.value[slots(have)], kind="stable")
            found.append(have[order[: len(have) - math.ceil(least * len(have) - 1e-9) + 1]])
            size.append(len(have))
        per = np.array([len(x) for x in found])
        gram = np.concatenate(found)
        of_row = pa.array(np.repeat(np.arange(len(per)), per))
        columns = [pa.array(gram.view(np.int64)), pa.array(shared.value[slots(gram)] > 0), batch.column("key").take(of_row), pa.array(np.repeat(size, per).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "hot", "key", "size"])

    @gives_memory_back
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}  # of the batch's documents, each once
            for key, text in zip([*batch.a, *batch.b], [*batch.text_a, *batch.text_b]):
                if key not in sets:
                    sets[key] = shingle_set(text, words_per_shingle)
            yield batch.loc[[jaccard(sets[x], sets[y]) >= least - 1e-9 for x, y in zip(batch.a, batch.b)], ["a", "b"]]

    def jaccard(x: np.ndarray, y: np.ndarray) -> float:
        if min(len(x), len(y)) < (least - 1e-9) * max(len(x), len(y)):
            return 0.0
        at = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else np.zeros(0, np.int64)
        both = int((y[at] == x).sum()) if len(y) else 0
        return both / max(1, len(x) + len(y) - both)

    def verified(pairs: DataFrame, of_key: DataFrame) -> DataFrame:
        both = pairs.join(of_key.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(of_key.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long")

    def may(x: Column, y: Column) -> Column:
        return F.least(x["size"], y["size"]) >= F.greatest(x["size"], y["size"]) * least - 1e-9

    sigs = stored(texts.mapInArrow(sign, "gram long, hot boolean, key long, size int"))  # read three times
    exact = linked(sigs, may, lambda keys: texts.join(keys, "key", "left_semi"), verified)
    discard(sigs)
    prints = stored(fingerprints(texts, words_per_shingle, "key"))
    heads = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))  # doc_id is the text's key
    same = prints.join(heads, "fp").where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = links(heads.select("fp"), radius, parts).join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    joined = components(exact.select("a", "b").unionByName(same).unionByName(near))
    for table in (exact, prints, heads, texts):
        discard(table)
    rooted = classes.join(joined, classes.key == joined.node, "left").select("first_id", F.coalesce("component", "key").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first_id").alias("doc_id")).select("doc_id")
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")
