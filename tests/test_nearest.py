"""Nearest rows by cells against brute force: ties, copies, own rows, odd vectors; cells of few rows, so that queries look into several."""

import numpy as np
import pytest

from trekspark.operators.learned import _nearest_of, knn_topk


def brute(q, rows, k):
    out = {}
    for name, v in q:
        found = sorted((round(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), 9), i) for i, x in rows if i != name)
        out[name] = [(r + 1, i, d) for r, (d, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize(("dims", "k", "row_block"), [(2, 5, 40), (5, 5, 100), (9, 12, 60), (3, 5, 5_000)])
def test_cells_find_what_brute_force_finds(spark, dims, k, row_block):
    r = np.random.default_rng(dims)
    at = np.concatenate([r.normal(0, 1, (500, dims)), np.round(r.normal(4, 1, (400, dims))), np.repeat(r.normal(-3, 1, (3, dims)), 60, 0)])
    rows = [(int(i), list(map(float, x))) for i, x in enumerate(at)]
    q = rows[::37] + [(10_000, [9.0] * dims), (10_001, rows[950][1])]
    odd = [(20_000, None), (20_001, [float("nan")] * dims), (20_002, [None] * dims)]
    got = {}
    for x in knn_topk(spark.createDataFrame(q + odd, "q long, v array<double>"), spark.createDataFrame(rows + odd, "id long, v array<double>"), k, 20, row_block).collect():
        got.setdefault(x.q, []).append((x.rank, x.id, x.dist))
    want = brute(q, rows, k)
    assert {n: [x[:2] for x in sorted(v)] for n, v in got.items()} == {n: [x[:2] for x in v] for n, v in want.items()}
    assert all(x[2] == pytest.approx(y[2], abs=2e-9) for n in want for x, y in zip(sorted(got[n]), want[n]))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(1, [0.0]), (3, [0.5])], "q long, v array<double>")
    assert sorted((x.q, x["rank"], x.id) for x in knn_topk(q, one).collect()) == [(1, 1, 2), (3, 1, 1), (3, 2, 2)]
    assert sorted((x.q, x["rank"], x.id) for x in knn_topk(q, one, row_block=1).collect()) == [(1, 1, 2), (3, 1, 1), (3, 2, 2)]
    assert knn_topk(q.limit(0), one).collect() == [] == knn_topk(q, one.limit(0)).collect()


def test_a_block_compares_few_rows_one_by_one(monkeypatch):
    """Rows beyond the bound are told apart by one matrix product; before, each query sorted all rows of a block."""
    r, seen = np.random.default_rng(0), []
    x = r.normal(0, 1, (4_000, 5))
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or sort(keys))
    _nearest_of(x, np.arange(4_000), x[:50], np.arange(50), np.full(50, np.inf), 5)
    assert len(seen) == 50 and max(seen) < 20


def test_leaves_find_what_the_product_finds(monkeypatch):
    """Few dimensions: only rows of the leaves in reach are compared; copies, own rows, bounds, few places."""
    from trekspark.operators import learned

    r, seen = np.random.default_rng(7), []
    for dims, n, k in ((1, 300, 3), (2, 900, 12), (5, 4_000, 5), (3, 3, 5)):
        x = np.concatenate([r.normal(0, 1, (n, dims)), np.round(r.normal(0, 1, (n, dims))), np.repeat(r.normal(0, 1, (1, dims)), 200, 0)])
        ids = r.permutation(len(x))
        at = r.choice(len(x), min(len(x), 150), replace=False)
        q, names = np.concatenate([x[at], r.normal(0, 2, (50, dims))]), np.concatenate([ids[at], np.arange(50) + 10**6])
        for bounds in (np.full(len(q), np.inf), np.where(r.random(len(q)) < 0.5, r.random(len(q)), np.inf)):
            want = sorted((int(a), int(b)) for a, b, _ in _nearest_of(x, ids, q, names, bounds, k))
            found = learned._nearest_by_leaves(x, ids, q, names, bounds, k)
            assert sorted(zip(found[0].tolist(), found[1].tolist(), strict=True)) == want
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or sort(keys))
    x = r.normal(0, 1, (20_000, 5))
    learned._nearest_by_leaves(x, np.arange(20_000), x[:100], np.arange(100), np.full(100, np.inf), 5)
    assert len(seen) == 2 and seen[1] < 20_000  # of two million pairs


def test_durations_are_predicted_for_all_test_rows(spark):
    from trekspark.fixtures import view
    from trekspark.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    held = view(spark, sf, "fx_s").where("track % 10 >= 7").count()
    assert QUERIES["knn_duration"](spark, sf).count() == held > 1_000
