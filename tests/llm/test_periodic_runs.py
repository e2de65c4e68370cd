"""Periodic runs against a plain search over all periods; appends of any size; nulls, ties, repeated and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from trekspark.llm import periodic_runs
from trekspark.llm.periodic_runs import SquareCatcher, runs_of_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) of every run: stretches by period, the smallest period of each stretch first."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - a >= max(6, 4 * q):
                found.setdefault((a, i - a), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    r = random.Random(1)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], [1, 1, 2] * 30, fibonacci(400), [1] * 100 + [2] + [1] * 100, list(range(100))]
    for _ in range(300):
        x = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))]
        q = r.randint(1, 40)
        stretch = [r.randrange(r.choice([2, 50])) for _ in range(q)]
        x += (stretch * 8)[: r.randint(3 * q, 7 * q)]
        out.append(x + [r.randrange(3) for _ in range(r.randint(0, 30))])
    return out


def test_runs_match_a_plain_search():
    texts = cases()
    sizes = np.array([len(x) for x in texts])
    text, runs = runs_of_texts(np.concatenate([np.array(x, np.int64) for x in texts]), sizes)
    for k, x in enumerate(texts):
        assert [tuple(r) for r in runs[text == k].tolist()] == plain_runs(x), x


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_appending_word_by_word_gives_the_same(size):
    for x in cases()[::5]:
        c = SquareCatcher(len(x))
        words = np.array([-1, *x], np.int64)
        for a in range(0, len(words), size):
            c.append(words[a : a + size])
        assert [(a - 1, n, q) for a, n, q in c.runs().tolist()] == plain_runs(x), x


def test_equal_hashes_of_different_words(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_ODD", np.array([0, 1], np.uint64))  # blocks are then told apart by their last word alone
    texts = cases()[:120]
    text, runs = runs_of_texts(np.concatenate([np.array(x, np.int64) for x in texts]), np.array([len(x) for x in texts]))
    for k, x in enumerate(texts):
        assert [tuple(r) for r in runs[text == k].tolist()] == plain_runs(x), x


def test_long_texts_are_cheap():
    n = 400_000
    for x, want in ((np.zeros(n, np.int64), [(0, n, 1)]), (np.arange(n) % 50_000, [(0, n, 50_000)]), (np.arange(n), []), (np.array(fibonacci(n)), [])):
        assert [tuple(r) for r in runs_of_texts(x, np.array([n]))[1].tolist()] == want


def digest(doc_id, text):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words, g = WORD.findall(text or ""), h // 10
    n = len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_matches_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(None, "ha " * 40, 1, "x"), (0, None, 1, "x"), (1, "", 1, "x"), (2, " \t\n", 1, "x"), (3, "  \x1c   " * 9, 1, "x"), (4, "la la la la la la", 1, "x")]
    for k in range(5, 300):
        vocabulary = [f"w{j}" for j in range(r.choice([2, 30, 900]))]
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 5, 40, 300]))]
        at = r.randrange(len(words))
        if k % 3 == 0:
            words[at:at] = words[at : at + r.randint(1, 9)] * r.randint(3, 9)
        rows.append((k, r.choice([" ", "\n", "  \x0b"]).join(words), 1, "x"))
    rows += rows[-40:]  # repeated rows
    rows.append((1000, " ".join(f"v{j % 700}" for j in range(6000)), 1, "x"))
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_dyadic_square_catching(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(*x[:2]) for x in rows), key=repr)


def test_small_slices_string_ids_and_empty_tables(spark, monkeypatch):
    rows = [(f"d{k}", "x y " * k, None) for k in range(40)]
    want = {(f"d{k}", f"{'x y' if k > 3 else ' '.join(['x y'] * k)}") for k in range(40)}
    monkeypatch.setattr(periodic_runs, "SLICE_CHARS", 10)
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id string, text string, other int"))
    assert {(x.doc_id, x.collapsed) for x in out.collect()} == want
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
