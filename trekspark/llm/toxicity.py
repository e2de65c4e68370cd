"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import gives_memory_back, read_table, with_columns

MAX_LABELLED = 8000  # documents that the classifier is fitted on, half of either label
DIMENSIONS = 1 << 18
THRESHOLD = 0.7
MEMO_WORDS = 300_000
MIN_WORDS = 5
CHUNK = 500  # documents of the sample whose gradient is taken at a time

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, and its first four and five letters."""
    out = [zlib.crc32(word.encode()) % DIMENSIONS]
    if len(word) >= 4:
        out.append(zlib.crc32(b"4" + word[:4].encode()) % DIMENSIONS)
    if len(word) >= 5:
        out.append(zlib.crc32(b"5" + word[:5].encode()) % DIMENSIONS)
    return out


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence; one of under five words goes on into
    the next, so that shouted or listed single words do not count as instances of their own."""
    out, words, first = [], set(), 0
    for m in _SENTENCE.finditer(text):
        found = _WORD.findall(m[0].lower())
        if found:
            first = first if words else m.start()
            words.update(found)
            last = m.end()
            if len(words) >= MIN_WORDS:
                out.append((first, last, words))
                words = set()
    if words:
        out.append((first, last, words))
    return out


@dataclass
class NoisyOrModel:
    """p(sentence) = sigmoid(bias + sum of its words' weights); p(document) = 1 - product of (1 - p(sentence))."""

    weights: np.ndarray
    bias: float

    def word_weight(self, word: str) -> float:
        return float(sum(self.weights[k] for k in word_features(word)))

    def sentence_scores(self, text: str | None, memo: dict[str, float]) -> list[tuple[int, int, float]]:
        out = []
        for start, end, words in sentences(text or ""):
            total = self.bias
            for w in words:
                x = memo.get(w)
                if x is None:
                    x = self.word_weight(w)
                    if len(memo) < MEMO_WORDS:
                        memo[w] = x
                total += x
            out.append((start, end, 1 / (1 + np.exp(-min(max(total, -60), 60)))))
        return out

    def score(self, text: str | None, memo: dict[str, float]) -> float:
        p = [x for _, _, x in self.sentence_scores(text, memo)]
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if p else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, toxic): at most ``max_labelled`` // 2 documents of either label, picked by a hash
    of the id; of repeated rows of an id, the least text. Null ids and labels are left out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2) for y in (0, 1)]
    some = picked[0].unionByName(picked[1])  # bounded by max_labelled rows
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


class _Chunk:
    """Some documents of the sample: their (sentence, feature) pairs by sentence for the scores, by feature for the gradient."""

    def __init__(self, rows: list[tuple], y: np.ndarray, place: np.ndarray) -> None:
        sizes = [np.frombuffer(r[2], np.int32) for r in rows]
        self.y, self.of_doc = y, np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in sizes])
        feature = place[np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])]
        of_sentence = np.repeat(np.arange(len(self.of_doc), dtype=np.int32), np.concatenate(sizes))[feature >= 0]
        self.feature = feature[feature >= 0]
        self.s_starts = np.flatnonzero(np.diff(of_sentence, prepend=-1))
        self.s_names = of_sentence[self.s_starts]
        order = np.argsort(self.feature, kind="stable")
        self.by_feature, in_order = of_sentence[order], self.feature[order]
        self.f_starts = np.flatnonzero(np.diff(in_order, prepend=-1))
        self.f_names = in_order[self.f_starts]

    def add_gradient(self, w: np.ndarray, bias: float, d_w: np.ndarray) -> float:
        """Add the weights' gradient to ``d_w``; the bias's is returned."""
        z = np.full(len(self.of_doc), bias)
        if len(self.feature):
            z[self.s_names] += np.add.reduceat(w[self.feature], self.s_starts)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-15, 1 - 1e-12)
        none = np.exp(np.bincount(self.of_doc, np.log1p(-p), len(self.y)))
        grad = np.where(self.y[self.of_doc] == 1, -p * (none / np.maximum(1 - none, 1e-12))[self.of_doc], p)
        if len(self.feature):
            d_w[self.f_names] += np.add.reduceat(grad.astype(np.float32)[self.by_feature], self.f_starts)
        return float(grad.sum())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 300, l1: float = 0.1, rate: float = 1.0, min_documents: int = 4) -> NoisyOrModel:
    """Fit on a bounded sample of labelled documents whose crc32(doc_id) mod 3 is not 1.

    Features are taken in Spark tasks from whole texts; the sample's feature ids come to the driver,
    partition by partition, where full-batch Adagrad with a soft threshold minimises the noisy-or negative log likelihood.
    Features in fewer than ``min_documents`` sampled documents get no weight. With no label of one
    kind, the model scores every document 0. Null and empty texts have no sentence; null ids, null labels and
    labels of absent documents are left out; of repeated labels of an id the largest counts.
    """

    @gives_memory_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, toxic in zip(batch.doc_id, batch.text, batch.toxic):
                found = [sorted({k for w in words for k in word_features(w)}) for _, _, words in sentences(text or "")]
                rows.append((doc_id, int(toxic), np.array([len(x) for x in found], np.int32).tobytes(), np.array([k for x in found for k in x], np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "sizes", "features"])

    sample = labelled_sample(docs, labels, max_labelled).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, sizes binary, features binary")
    rows = sorted(((r.doc_id, r.toxic, bytes(r.sizes), bytes(r.features)) for r in sample.toLocalIterator()), key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.int32)
    if not len(y) or y.min() == y.max():
        return NoisyOrModel(np.zeros(DIMENSIONS, np.float32), -60.0)
    seen = np.zeros(DIMENSIONS, np.int32)
    for r in rows:
        seen[np.unique(np.frombuffer(r[3], np.int32))] += 1
    names = np.flatnonzero(seen >= min_documents)
    if not len(names):
        return NoisyOrModel(np.zeros(DIMENSIONS, np.float32), -60.0)
    place = np.full(DIMENSIONS, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    chunks = []
    for first in range(0, len(rows), CHUNK):
        chunks.append(_Chunk(rows[first : first + CHUNK], y[first : first + CHUNK], place))
        rows[first : first + CHUNK] = [None] * len(chunks[-1].y)  # its bytes are not needed again
    w, bias = np.zeros(len(names), np.float32), -4.0
    g_w, g_b = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        d_w, d_b = np.zeros(len(names)), 0.0
        for chunk in chunks:
            d_b += chunk.add_gradient(w, bias, d_w)
        g_w += d_w**2
        g_b += d_b**2
        step = rate / np.sqrt(g_w)
        moved = w - step * d_w
        w = (np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)).astype(np.float32)
        bias -= rate / np.sqrt(g_b) * d_b
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[names] = w
    return NoisyOrModel(weights, float(bias))


def score(docs: DataFrame, model: NoisyOrModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double and predicted int (1 if score >= threshold). Null and empty texts
    score 0. Any other columns pass through, but for earlier ones named score and predicted; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")))

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores = np.array([shared.value.score(t.as_py(), memo) for t in batch.column("text")], float)
            yield with_columns(batch, {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def offending_sentences(docs: DataFrame, model: NoisyOrModel, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, start, end, score, text) of each sentence whose own score is at least ``least``; offsets in
    characters. Null and empty texts have none; ids may be null or repeat, and each row counts; an empty table gives
    an empty result; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["sentence", "start", "end", "score", "text"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            rows = [(i, n, a, b, float(p), t.as_py()[a:b]) for i, t in enumerate(batch.column(1)) for n, (a, b, p) in enumerate(shared.value.sentence_scores(t.as_py(), memo)) if p >= least]
            at, *columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, y) for x, y in zip(columns, types))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence int, start int, end int, score double, text string")


def op4_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)").alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")
