"""Periodic runs of words: online dyadic square catching, and texts with each run collapsed to its first period."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import gives_memory_back, read_table

LEAST_WORDS = 6
LEAST_EXPONENT = 4
PIECE_WORDS = 1 << 17  # that are appended at a time
SLICE_CHARS = 4_000_000  # of texts that a task looks at together

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # any two odd numbers do
_EMPTY = np.empty(0, np.int64)


@dataclass
class _Catcher:
    """Catches squares by blocks of ``size`` words that begin at every half block: a completed block is compared with
    the stretches of its length that begin over size/2 to size words before it."""

    size: int
    first: int = 0  # position of hashes[0]
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    block: int = 0  # the next block to be completed

    def __post_init__(self) -> None:
        self.step, self.block = max(1, self.size // 2), self.size

    def catch(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks completed within the first ``n`` words, each with a distance at which its words stand before it."""
        count = (n - self.size - self.block) // self.step + 1
        if count <= 0:
            return _EMPTY, _EMPTY
        own, before = self.block - self.first, self.block - self.size - self.first
        key = self.hashes[own : own + (count - 1) * self.step + 1 : self.step]
        if self.step <= 16:
            found = [np.flatnonzero(self.hashes[before + c : before + c + (count - 1) * self.step + 1 : self.step] == key) for c in range(self.step)]
            rows, shift = np.concatenate(found), np.repeat(np.arange(self.step), [len(x) for x in found])
        else:
            rows, shift = np.nonzero(self.hashes[before : before + count * self.step].reshape(count, self.step) == key[:, None])
        at = self.block + rows * self.step
        self.block += count * self.step
        return at, self.size - shift


class SquareCatcher:
    """Repetitions in a growing sequence of words, given as numbers.

    ``append`` takes further words. First the squares that are still open take them in, as long as each equals the word a
    period before; then the catchers of all sizes 1, 2, 4, ... look at the blocks that the new words complete. A block
    of g words whose words stand d words before it, g/2 < d <= g, is a square of period d. Squares of
    one period and neighbouring blocks are merged, those within a known square of period d or a divisor are dropped, and the
    others are extended to both sides word by word. Each known square is a maximal stretch of its period; ``runs`` are those that are long enough.

    Every stretch of smallest period d and at least 4 d words holds a block of the size g with g/2 < d <= g and the
    same block d words before, wherever it begins: it has over d + 1 places for the block, which begins at every g/2 words. So none is missed.
    Work a word is one comparison a size; blocks are compared by hashes of 64 bits and what is found by its words. Only the last four
    blocks' hashes of each size are held.
    """

    def __init__(self, longest: int) -> None:
        """``longest``: no stretch of period is longer than this."""
        self.catchers = [_Catcher(1)]
        while LEAST_EXPONENT * (self.catchers[-1].size + 1) <= longest:
            self.catchers.append(_Catcher(2 * self.catchers[-1].size))
        self.n, self._words = 0, _EMPTY
        self.start, self.end, self.period = _EMPTY, _EMPTY, _EMPTY

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self._words):
            grown = np.empty(max(2 * self.n, self.n + len(words)), np.int64)
            grown[: self.n] = self._words[: self.n]
            self._words = grown
        self._words[self.n : self.n + len(words)] = words
        was, self.n = self.n, self.n + len(words)
        open_ = np.flatnonzero(self.end == was)
        self.end[open_] += self._equal(self.end[open_], self.period[open_], 1)
        lower = None
        for c in self.catchers:
            known = c.first + len(c.hashes)
            if lower is None:
                new = self._words[known : self.n].view(np.uint64)
            else:
                a = lower.hashes[known - lower.first :]
                half = lower.size
                new = a[: max(0, len(a) - half)] * _ODD[0] + a[half:] * _ODD[1]
                new ^= new >> np.uint64(29)
            c.hashes = np.concatenate([c.hashes, new]) if len(c.hashes) else new
            self._add(c, *c.catch(self.n))
            lower = c
        for c in self.catchers:
            drop = max(0, min(len(c.hashes), self.n - 4 * c.size - c.first))
            c.hashes, c.first = c.hashes[drop:], c.first + drop

    def _equal(self, at: np.ndarray, period: np.ndarray, way: int) -> np.ndarray:
        """How many words from ``at`` on (or before it, for way -1) equal the one a period before (or after) them."""
        out, live, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
        while len(live):
            x = at[live, None] - (way < 0) + way * (out[live, None] + np.arange(width))
            there = (x >= 0) & (x < self.n)
            x = np.where(there, x, 0)
            y = np.clip(x - way * period[live, None], 0, self.n - 1)
            same = there & (self._words[x] == self._words[y])
            all_ = same.all(1)
            out[live] += np.where(all_, width, same.argmin(1))
            live, width = live[all_], min(2 * width, 1024)
        return out

    def _add(self, c: _Catcher, at: np.ndarray, d: np.ndarray) -> None:
        fresh = ~self._known(at, d, c.size)
        at, d = at[fresh], d[fresh]
        if not len(at):
            return
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        new = np.append(True, (np.diff(d) != 0) | (np.diff(at) > c.step))
        last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        low, high, d = at[new] - d[new], at[last] + c.size, d[new]
        low, high, d = self._verified(low, high, d) if c.size > 1 else (low, high, d)
        low = low - self._equal(low, d, -1)
        high = high + self._equal(high, d, 1)
        self.start, self.end, self.period = np.append(self.start, low), np.append(self.end, high), np.append(self.period, d)

    def _known(self, at: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
        """Which blocks lie, with their copies, in a known square of period d or a divisor: two of such length would be the same
        one, so the one that ends last among those that begin early enough decides."""
        if not len(at):
            return np.zeros(0, bool)
        near = np.flatnonzero(self.end >= at.min() + size)
        if not len(near):
            return np.zeros(len(at), bool)
        near = near[np.argsort(self.start[near], kind="stable")]
        end = self.end[near]
        holder = np.maximum.accumulate(np.where(end == np.maximum.accumulate(end), np.arange(len(near)), 0))
        k = np.searchsorted(self.start[near], at - d, side="right") - 1
        held = near[holder[np.maximum(k, 0)]]
        return (k >= 0) & (self.end[held] >= at + size) & (d % self.period[held] == 0)

    def _verified(self, low: np.ndarray, high: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same squares where their words agree; else what stretches of period d their words do hold."""
        size = high - low - d
        begin = np.cumsum(size) - size
        x = np.repeat(low - begin, size) + np.arange(size.sum())
        same = self._words[x] == self._words[x + np.repeat(d, size)]
        good = np.logical_and.reduceat(same, begin)
        if good.all():
            return low, high, d
        out = [(low[good], high[good], d[good])]
        for k in np.flatnonzero(~good):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same[begin[k] : begin[k] + size[k]].astype(np.int8), [0]])))
            a, b = low[k] + edge[::2], low[k] + edge[1::2] + d[k]
            long = b - a >= 2 * d[k]
            out.append((a[long], b[long], np.full(long.sum(), d[k])))
        return tuple(np.concatenate(z) for z in zip(*out))

    def runs(self, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
        """(start, length, period) of maximal stretches of smallest period, by start, then period."""
        length = self.end - self.start
        keep = length >= np.maximum(least_words, least_exponent * self.period)
        out = np.stack([self.start, length, self.period], 1)[keep]
        out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
        return out[np.append(True, (np.diff(out[:, :2], axis=0) != 0).any(1))] if len(out) else out


def runs_of_texts(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, runs) of texts whose word numbers stand one after another: texts of like length go through one
    catcher, a number of its own before each, so no stretch reaches over two."""
    begin = np.cumsum(sizes) - sizes
    found = [(_EMPTY, np.empty((0, 3), np.int64))]
    classes = np.frexp(sizes)[1]
    for k in np.unique(classes[sizes >= LEAST_WORDS]):
        texts = np.flatnonzero(classes == k)
        n = sizes[texts]
        at = np.cumsum(n + 1) - n
        stream = np.empty((n + 1).sum(), np.int64)
        stream[at - 1] = -1 - np.arange(len(texts))
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        stream[np.repeat(at, n) + inner] = words[np.repeat(begin[texts], n) + inner]
        catcher = SquareCatcher(n.max())
        for a in range(0, len(stream), PIECE_WORDS):
            catcher.append(stream[a : a + PIECE_WORDS])
        runs = catcher.runs()
        text = np.searchsorted(at, runs[:, 0], side="right") - 1
        runs[:, 0] -= at[text]
        found.append((texts[text], runs))
    text, runs = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    return text[order], runs[order]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between white space of texts (null: none), one after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, ends = split.flatten(), split.offsets.to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there), np.diff(before[ends - ends[0]])


def collapsed(words: pa.Array, sizes: np.ndarray, text: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Texts without the words that stand in a run after its first period, joined by one space."""
    begin = np.cumsum(sizes) - sizes
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin[text] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, begin[text] + runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = pa.array(before[np.append(begin, len(words))], pa.int32())  # a text has under 2 GB, so fewer words than 2**30
    kept = words if keep.all() else words.filter(pa.array(keep))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, kept), pa.scalar(" ", kept.type))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, runs (start, length, period of each run of words, by start, then period) and collapsed (its words
    joined by one space, without those that stand in a run after its first period).

    Words are what stands between ASCII white space. A run is a stretch of words of smallest period q, at least 6 and 4 q
    words long, that no neighbouring word extends. A null or empty text has no runs and is empty; ids of any type and null ids pass
    through; repeated rows are looked at each; an empty table gives an empty result; further columns are not
    read. Nothing is shuffled: a task holds texts of about SLICE_CHARS, or one text where it is longer, with some
    30 numbers a word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(chars, (chars[first - 1] if first else 0) + SLICE_CHARS, side="right")))
                yield table(batch.slice(first, last - first))
                first = last

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, sizes = words_of(batch.column(1))
        numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        text, runs = runs_of_texts(numbers, sizes)
        offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(run_type)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, collapsed(words, sizes, text, runs).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; by crc32 of the id, a tenth of texts with a word repeat a stretch from one of their words on to
    the end. A null id's text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.size("_words")
    rows = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("_words"))
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    a, p = F.col("_a"), F.col("_p")
    word = lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(F.col("text")).alias("text"))


def _digest() -> dict[str, Column]:
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    length, period = -best["shorter"], best["period"]
    return {
        "n_runs": F.size("runs").cast("long"),
        "start": best["start"],
        "length": length,
        "period": period,
        "exponent_milli": F.floor(1000 * length / period),
        "runs_sha256": F.sha2(lines, 256),
        "collapsed_sha256": F.sha2("collapsed", 256),
    }


def op13_dyadic_square_catching(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_repeats(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", *(c.alias(n) for n, c in _digest().items()))
