"""Packing token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from trekspark.llm.common import gives_memory_back, read_table

CAPACITY = 2048
END_ID = 1
SHARD_TOKENS = 2_000_000  # that are packed together in a task
MEMO_CHUNKS = 400_000  # that a worker remembers at a time; the older half goes when there are more
VOCABULARY = "word_bpe_49k.json"

_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_STEM = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")  # a word and punctuation without apostrophes


class ChunkEncoder:
    """Token ids of texts, chunk by chunk between white space: where the vocabulary's pre-tokenizer drops
    white space and never joins across it, each chunk's ids stand alone and can be remembered. Other
    vocabularies encode whole texts."""

    def __init__(self, path: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.any_end = sum(len(t) == 5 and t.endswith("</w>") for t in vocab) >= 256  # a word may end with any byte
        self.by_chunk = self._stands_alone()

    def _stands_alone(self) -> bool:
        """Whether lower-cased chunks between white space are encoded on their own, as far as probes tell."""
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probes = ["Ab", "word", "don't", "x.", "\u00c9t\u00e9", "3.5", "...", "naming"]
        joined = [encode(gap.join(probes)) for gap in (" ", "  ", "\n", "\t ", "\r\n", " \n\n")]
        alone = [x for p in probes for x in encode(p)]
        return self.ends.any() and all(x == alone for x in joined) and encode("WORD") == encode("word") and encode(" a ") == encode("a") and encode("ab.,") == encode("ab") + encode(".,") and encode("\u00c9b!#*") == encode("\u00e9b") + encode("!#*")

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of new chunks. Words, without the punctuation at their end and in lower case, go
        through the encoder as one text, cut where a word ends; the rest one by one."""
        found = self.memo
        plain, other, lone, parts = set(), set(), [], []
        for c in chunks:
            m = _STEM.fullmatch(c)
            if m is None or not (self.any_end or c.isascii()):
                lone.append(c)
                continue
            word, tail = m.groups()
            if word.isascii() or word.isalpha() and "\u0130" not in word and max(word) < "\u0250":  # letters that have one small letter, a letter too
                low = word.lower()
                (plain if low.isascii() else other).add(low)
                if low != c:
                    parts.append((c, low, tail))
            elif word == c and c.isalpha():
                other.add(c)
            else:
                lone.append(c)
        lone += {tail for *_, tail in parts}.difference(found)
        words = [*plain.difference(found)]
        words += [""] * (-len(words) % 1000)  # so that the others have texts of their own
        words += other.difference(found)
        for first in range(0, len(words), 1000):
            some = [w for w in words[first : first + 1000] if w]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                lone += some
                continue
            data, at = ids.tobytes(), 0
            for w, b in zip(some, (4 * cuts).tolist()):
                found[w] = data[at:b]
                at = b
        if lone:
            for c, e in zip(lone, self.tokenizer.encode_batch_fast(lone, add_special_tokens=False)):
                found[c] = np.array(e.ids, "<u4").tobytes()
        for c, word, tail in parts:
            found[c] = found[word] + found[tail]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        chunks = [_ASCII_SPACE.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.memo) > MEMO_CHUNKS // 2:
            self.memo, self.older = {"": b""}, self.memo
        known, older = self.memo, self.older
        found = [list(map(known.get, row)) for row in chunks]
        gaps = [[k for k, x in enumerate(ids) if x is None] if None in ids else [] for ids in found]
        new = {row[k] for row, at in zip(chunks, gaps) for k in at}
        if older and new:
            again = {c: older[c] for c in new if c in older}
            known.update(again)
            new.difference_update(again)
        if new:
            self.learn(list(new))
        for row, ids, at in zip(chunks, found, gaps):
            for k in at:
                ids[k] = known[row[k]]
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]


_encoders: dict[str | None, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def best_fill(counts: Counter, room: int) -> Counter:
    """The multiset of lengths from ``counts`` whose sum is the largest that is at most ``room``.

    Subset sums are the set bits of one integer; a length with count c is added in 1, 2, 4, ... copies
    and a rest, so c copies cost about log c shifts. The sums before each step are kept, and tracing
    them back gives the copies of each length.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= sums << (length * copies) & mask
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, Counter()
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            out[length] += copies
            at -= length * copies
    return out


def pack_pieces(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) that hold each token of documents of ``sizes`` once.

    Whole windows are cut from long documents first. Then the longest piece left seeds a window and
    minimum bin slack picks the multiset of lengths that fills it closest to capacity; the pattern is
    used as often as the counts allow. If no multiset closes a window, the longest piece left is cut to
    close it. The last window's tokens are cut into sequences whose lengths are powers of two, which
    need no padding either.
    """
    out: list[list[tuple[int, int, int]]] = []
    pool: dict[int, list[tuple[int, int]]] = {}
    for doc, n in enumerate(sizes):
        whole = n - n % capacity
        out += [[(doc, a, capacity)] for a in range(0, whole, capacity)]
        if n > whole:
            pool.setdefault(n - whole, []).append((doc, whole))
    counts = Counter({n: len(x) for n, x in pool.items()})
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        fill = best_fill(counts, capacity - seed)
        counts[seed] += 1
        fill[seed] += 1
        slack = capacity - sum(n * k for n, k in fill.items())
        times = min(counts[n] // k for n, k in fill.items()) if not slack else 1
        for _ in range(times):
            out.append([(*pool[n].pop(), n) for n, k in fill.items() for _ in range(k)])
        counts.subtract({n: k * times for n, k in fill.items()})
        counts = +counts
        if slack and counts:
            long = max(counts)
            doc, start = pool[long].pop()
            out[-1].append((doc, start, slack))
            pool.setdefault(long - slack, []).append((doc, start + slack))
            counts[long] -= 1
            counts[long - slack] += 1
            counts = +counts
        elif slack:
            out += _powers_of_two(out.pop(), capacity - slack)
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, pieces = [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        if room:
            out.append([])
        while room:
            doc, start, n = pieces.pop()
            if n > room:
                pieces.append((doc, start + room, n - room))
                n = room
            out[-1].append((doc, start, n))
            room -= n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the vocabulary's, then ``end_id``; a null or empty text has that id alone.
    Each task packs its documents in shards of about ``shard_tokens`` ids, so nothing is shuffled and
    a lost task gives the same pieces again. Repeated rows are packed as often as they occur; ids of any
    type and null ids pass through as they are. An empty table gives an empty result; other columns of ``docs`` are not read.
    """

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        made = TaskContext.get().partitionId() << 36
        names, ids, held = [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                names.append(part.column(0))
                for x in enc.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids.append(np.append(x, np.uint32(end_id)))
                    held += len(ids[-1])
                if held >= shard_tokens:
                    yield rows(names, ids, made)
                    made, names, ids, held = made + (1 << 20), [], [], 0
        if names:
            yield rows(names, ids, made)

    def rows(names: list[pa.Array], ids: list[np.ndarray], made: int) -> pa.RecordBatch:
        out = []
        for n, pieces in enumerate(pack_pieces([len(x) for x in ids], capacity)):
            offset = 0
            for doc, start, length in pieces:
                out.append((doc, start, length, zlib.crc32(ids[doc][start : start + length]), len(ids[doc]), made + n, offset))
                offset += length
        doc, *columns = zip(*out)
        of_doc = pa.concat_arrays(names).take(pa.array(doc))
        return pa.RecordBatch.from_arrays([of_doc, *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
