"""Substring joins against every text with every pattern."""

import random

import pytest

from strata.functions import text as T
from strata.operators import substrings as S


def strings(rng, n, most):
    return ["".join(rng.choice("abé/") for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("seed,q", [(1, 3), (2, 3), (3, 2), (4, 5)])
def test_against_all_pairs(spark, seed, q):
    rng = random.Random(seed)
    texts = [(i, t) for i, t in enumerate(strings(rng, 60, 14))] + [(7, "same id"), (8, None), (None, "abab"), (3, "")]
    texts += texts[:4]
    patterns = strings(rng, 40, 7) + ["zz", "nowhere", "", None, "same id"]
    got = S.containing(spark.createDataFrame([(*t, "x", 1) for t in texts], "id long, text string, gram string, n int"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), q)
    want = {(i, p) for i, t in texts for p in patterns if t is not None and p is not None and p in t and i is not None}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and {r for r in rows if r[0] is not None} == want


def test_no_rows(spark):
    t, p = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("a",)], "pattern string")
    assert S.containing(t, p.limit(0)).count() == 0 and S.containing(t.limit(0), p).count() == 0 and [tuple(r) for r in S.containing(t, p).collect()] == [(1, "a")]


def test_related_paths(spark):
    files = ["a/b/c.py", "b/c.py", "c.py", "x/y.ts", "a/b", "d/c.pyx", ""]
    targets = ["b/c.py", "a/b", "c.py", "zz/x/y.ts", "", "y.ts", "q"]
    t, f = spark.createDataFrame([(x,) for x in targets], "target string"), spark.createDataFrame([(x,) for x in files], "file string")
    from pyspark.sql import functions as F

    want = sorted(map(tuple, t.crossJoin(f).filter(T.paths_related(F.col("target"), F.col("file"))).collect()))
    assert sorted(map(tuple, S.related_paths(t, f).collect())) == want
