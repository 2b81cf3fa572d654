"""op13 against all pairs, on ties, copies, null ids and labels."""

import math

import numpy as np
import pytest

from strata.llm import ball_tree as B
from strata.llm import hard_negatives as H

KIND = "vec_id long, embedding array<double>, label int, name string, score long"


def brute(rows):
    kept = []
    for i, v, label in rows:
        if label is not None and v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for k, (a, x, la) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), 2**63 if i is None else i, lb, j) for j, (i, y, lb) in enumerate(kept)]
        for ps, pid, _, _ in sorted((s, i, lb, j) for s, i, lb, j in scored if lb == la and j != k)[:5]:
            hard = sorted((s, i) for s, i, lb, _ in scored if lb != la and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(a, None if pid == 2**63 else pid, r + 1, None if i == 2**63 else i, -ps, -s) for r, (s, i) in enumerate(hard)]
    return sorted(out, key=str)


def rows_of(seed, n=700):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).round(2)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    rows = [(int(i) * 4, v.tolist(), int(rng.integers(4))) for i, v in enumerate(x)]
    rows += [rows[25], rows[0], rows[-100]]  # anchors again
    return rows + [(None, x[-1].tolist(), 1), (None, x[0].tolist(), 2), (3, None, 1), (6, [1.0] * 6, None), (9, [float("nan")] * 6, 1), (12, [1.0, None] * 3, 1), (15, [1.0], 1), (18, [], 1), (800000, [0.0] * 6, 1), (900000, [0.0] * 6, 1)]


@pytest.mark.parametrize("seed,leaf,tree", [(1, 256, 1 << 24), (2, 8, 48 * 100), (3, 3, 48 * 10)])
def test_against_all_pairs(spark, monkeypatch, seed, leaf, tree):
    monkeypatch.setattr(H, "TREE_BYTES", tree)
    monkeypatch.setattr(H, "BLOCK_BYTES", tree // 16)
    monkeypatch.setattr(B, "LEAF", leaf)
    monkeypatch.setattr(H, "TREES", 3)
    monkeypatch.setattr(H, "BLOCKS", 2)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], KIND).repartition(3)
    got = H.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [1.0] * 6, 1)], [(101, [1.0] * 6, 1)], [(100, [1.0] * 6, 1), (102, [1.0] * 6, 1)]])
def test_few_rows(spark, rows):
    assert sorted(map(tuple, H.hard_negatives(spark.createDataFrame([(*r, "n", 1) for r in rows], KIND)).collect())) == brute(rows)


def test_bounds_prune_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 500
    x = (centres[np.repeat(np.arange(40), 300)] + rng.normal(size=(12000, 16)) * 8).astype(np.int64)
    tree = B.build(np.arange(12000), np.zeros(12000, np.int64), x)
    best = B.Best(20, 10)
    seen = B.search(tree, best, x[:20], np.arange(20), np.zeros(20, np.int64), True)
    score = x[:20] @ x.T
    for q in range(20):
        want = np.lexsort((np.arange(12000), -score[q]))[:10]
        assert best.rows[2][best.rows[0] == q].tolist() == want.tolist()
    assert seen < 0.2 * score.size
    low = high = score.max(axis=1) // 2
    few = B.search(tree, B.Best(20, 10), x[:20], np.arange(20), np.ones(20, np.int64), False, low, high)
    assert few < 0.5 * score.size


def test_products_are_exact():
    a = np.array([[2**30, 3], [1, -(2**30)]])
    assert B.products(a, a).tolist() == [[2**60 + 9, 2**30 - 3 * 2**30], [2**30 - 3 * 2**30, 1 + 2**60]]
    with pytest.raises(OverflowError):
        B.products(a * 2**10, a)
