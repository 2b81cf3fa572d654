"""The stored index against BM25 over all postings, through updates, and how much of it a search reads."""

import random

from pyspark.sql import functions as F

from strata.operators import search as S
from strata.operators import text_index as X

WEIGHTS = {"name": 0.5, "body": 1.0}


def docs_of(rng, n, start=0):
    words = [f"{a}{b}" for a in ("get", "user", "model", "load") for b in ("", "s", "er", "42")] + [f"rare{i}" for i in range(60)]
    return [(f"d{i:04}", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30]))), "x") for i in range(start, start + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, body string, token string")


def best(df, k):
    return [(r["id"], round(r["score"], 9), r["matched"]) for r in df.orderBy(F.round("score", 9), "id").limit(k).collect()]


def test_equal_to_all_postings_through_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "GROUP", 8)
    rng = random.Random(1)
    rows = {r[0]: r for r in docs_of(rng, 200)}
    index = X.TextIndex(spark, str(tmp_path / "i"))
    index.build(frame(spark, list(rows.values())), WEIGHTS)

    def check(queries, k):
        now = frame(spark, list(rows.values())).cache()
        p = S.postings(now, "id", WEIGHTS).cache()
        for q in queries:
            assert best(index.search(q, k), k) == best(S.bm25(p, now.count(), q), k), q

    check([["get", "rare7"], ["mod", "load42", "nothing"], ["zzz"]], 7)
    before = index.store.version()
    new = docs_of(rng, 20, 190)  # ten changed, ten new
    rows |= {r[0]: r for r in new}
    index.update(frame(spark, new), spark.createDataFrame([("d0003",), ("d0195",), ("none",)], "id string"))
    rows.pop("d0003")
    check([["get", "rare7", "loader"]], 5)
    again = docs_of(rng, 3, 195)
    rows |= {r[0]: r for r in again}
    index.update(frame(spark, again))
    check([["rare", "users"]], 300)
    assert index.store.read("docs", before).count() == 200 and index.store.version().notes["docs"] == len(rows)


def test_empty(spark, tmp_path):
    index = X.TextIndex(spark, str(tmp_path / "i"))
    index.build(frame(spark, []), WEIGHTS)
    assert index.search(["a"], 3).count() == 0 and index.search([], 3).count() == 0
    index.update(frame(spark, [("a", "one", None, "")]))
    assert [r["id"] for r in index.search(["on"], 3).collect()] == ["a"]


def test_a_search_reads_few_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "GROUP", 16)
    rng = random.Random(2)
    rows = [(f"d{i:05}", "common", " ".join(["common"] * rng.randrange(1, 4) + [f"w{rng.randrange(900)}" for _ in range(40)]), "") for i in range(3000)]
    rows += [(f"e{i}", "special", "special common special", "") for i in range(10)]
    index = X.TextIndex(spark, str(tmp_path / "i"))
    index.build(frame(spark, rows), WEIGHTS)
    read, all_ = index.postings_read(["special", "common"], 5)
    assert read < 0.05 * all_ and best(index.search(["special", "common"], 5), 5) == best(S.bm25(S.postings(frame(spark, rows), "id", WEIGHTS), len(rows), ["special", "common"]), 5)


def test_equal_parts_have_equal_sums_in_any_order(spark):
    from strata.operators.search import in_order

    values = {"a": 0.1, "b": 0.2, "c": 0.3, "d": 1e-17, "e": 0.7}
    rows = [(i, q, values[q]) for i in range(40) for q in random.Random(i).sample(sorted(values), 5)]
    x = spark.createDataFrame(rows, "id long, q string, v double").coalesce(1).groupBy("id").agg(in_order("q", F.col("v")).alias("s"))
    assert len({r["s"] for r in x.collect()}) == 1
