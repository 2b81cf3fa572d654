"""Top-k of many queries against one product of all rows; recall of the inverted lists."""

import numpy as np

from strata.operators import vectors as V

KIND = "vec_id long, embedding array<float>, score double"


def rows_of(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(12, size=n)] + 0.2 * rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are one vector
    x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
    return [(int(i), [float(c) for c in v], 0.0) for i, v in enumerate(x)]


def brute(rows, queries, k):
    out = []
    x = np.array([r[1] for r in rows])
    for i, q, _ in queries:
        s = (np.array(q)[None, :] @ x.T)[0] / np.sqrt((np.array(q) ** 2).sum())
        out += [(i, n + 1, rows[j][0], round(float(s[j]), 9)) for n, j in enumerate(np.lexsort(([r[0] for r in rows], -s.round(12)))[:k])]
    return sorted(out)


def shown(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_exact_and_all_lists(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 50)
    monkeypatch.setattr(V, "QUERIES", 4)
    rows = rows_of(300)
    odd = [(900, None, 0.0), (901, [], 0.0), (902, [1.0] * 7, 0.0), (903, [float("nan")] * 8, 0.0), (None, rows[5][1], 0.0)]
    df = spark.createDataFrame(rows + odd, KIND).repartition(3)
    q = df.filter("vec_id % 50 = 7")
    exact = V.exact_topk(df, q, 9)
    want = brute(rows, [r for r in rows if r[0] % 50 == 7], 9)
    got = shown(exact)
    assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want]
    lists = V.InvertedLists(df)
    assert shown(lists.topk(q, 9, len(lists.centroids))) == got and lists.lists.count() == 300
    assert V.recall(lists.topk(q, 9, len(lists.centroids) // 2), exact).agg({"recall": "avg"}).first()[0] >= 0.9


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert V.exact_topk(none, none, 3).count() == 0 and V.InvertedLists(none).topk(none, 3, 2).count() == 0
