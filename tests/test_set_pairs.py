"""Pairs of rows with like sets, by classes of equal sets, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import code as C
from strata.operators import store

SETS = [["a", "b", "c", "d"], ["d", "c", "b", "a"], ["a", "b", "c", "d", "e"], ["x", "y"], ["y"], [], ["a", "b", "c", "e"]]


def like(p, q):
    return len(set(p) & set(q)) / len(set(p) | set(q)) if p and q else 0.0


def test_pairs_of_classes(spark):
    rows = [(i, SETS[i * 5 % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = sorted((a, b, int(like(p, q) * 100 + 0.5) / 100) for (a, p), (b, q) in itertools.combinations(rows, 2) if like(p, q) >= 0.6)
    assert sorted(map(tuple, C.similar_tokens(df, 0.6, 2).collect())) == want
    first = C.overlapping(df.withColumnRenamed("tokens", "members"), 0.6, 2, first=9)
    assert list(map(tuple, first.collect())) == want[:9]


@pytest.mark.parametrize("most", [7, 5000])
def test_first_pairs_of_like_structure(spark, most):
    rows = [(i, SETS[i % 7], 12 + i * 7 % 33, str(i % 4)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, kinds array<string>, size int, hash string")
    want = [(a, b, int(like(p, q) * 1000 + 0.5) / 1000) for (a, p, m, g), (b, q, n, h) in itertools.combinations(rows, 2) if like(p, q) >= 0.6 and g != h and abs(m // 10 - n // 10) <= 1]
    assert sorted(map(tuple, C.similar_structure(df, 0.6).collect())) == sorted(want)
    assert list(map(tuple, C.similar_structure(df, 0.6, first=most).collect())) == sorted(want, key=lambda r: (-r[2], r[0], r[1]))[:most]


@pytest.mark.parametrize("least", [0.6, 0.75])
def test_equal_sizes_keep_all_pairs(spark, least):
    rng = random.Random(3)
    rows = [(i, rng.sample(range(9), 1 + i % 8)) for i in range(90)]
    want = {(a, b) for (a, p), (b, q) in itertools.combinations(rows, 2) if len(p) == len(q) and like(p, q) >= least}
    assert {(r["a"], r["b"]) for r in store.similar_sets(spark.createDataFrame(rows, "k long, a array<long>"), least).collect()} == want


def test_suffixes_are_merged_without_broadcasts(spark):
    rows = spark.createDataFrame([("b/a/x.py", "one"), ("a/x.py", "two"), ("y.py", "")], "path string, body string")
    merged = C.merged_suffixes(rows, "path", "body")
    assert sorted(map(tuple, merged.collect())) == [("b/a/x.py", "one two"), ("y.py", "")]
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()

def test_blocks_of_rows_are_listed_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50, raising=False)
    monkeypatch.setattr("strata.operators.components.BROADCAST", 100)
    rows = [(i, SETS[i % 3], 12, str(i % 2)) for i in range(600)] + [(7, SETS[0], 12, "1"), (8, SETS[2], 12, "1")]
    df = spark.createDataFrame(rows, "id long, kinds array<string>, size int, hash string")
    want = sorted((min(a, b), max(a, b), int(like(p, q) * 1000 + 0.5) / 1000) for (a, p, _, g), (b, q, _, h) in itertools.combinations(rows, 2) if a != b and g != h and like(p, q) >= 0.6)
    pairs = C.similar_structure(df, 0.6)
    assert sorted(map(tuple, pairs.collect())) == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    tokens = df.select("id", F.col("kinds").alias("tokens"))
    want = sorted((min(a, b), max(a, b), int(like(p, q) * 100 + 0.5) / 100) for (a, p, _, _), (b, q, _, _) in itertools.combinations(rows, 2) if a != b and like(p, q) >= 0.6)
    pairs = C.similar_tokens(tokens, 0.6, 2)
    assert sorted(map(tuple, pairs.collect())) == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
