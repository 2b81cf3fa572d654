"""Strongly connected parts and reachability against walks; page components by hand."""

import random

import pytest

from strata.operators import components as K


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in edges:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 22)])
def test_against_walks(spark, seed, n):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(n)})
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = {v for e in edges for v in e}
    to = {v: reach(edges, v) for v in nodes}
    same = {v: max(w for w in nodes if w in to[v] and v in to[w]) for v in nodes}
    sizes = {}
    for v in nodes:
        sizes[same[v]] = sizes.get(same[v], 0) + 1
    assert {r["id"]: r["part"] for r in K.cyclic_parts(df).collect()} == {v: p for v, p in same.items() if sizes[p] > 1}
    roots = ["n01", "n05", "n09", "alone"]
    got = K.reached(df, spark.createDataFrame([(r,) for r in roots], "id string")).collect()
    assert sorted(map(tuple, got)) == sorted((r, v) for r in roots for v in to.get(r, {r}))


def test_pages(spark):
    edges = spark.createDataFrame([("P", "A"), ("A", "B"), ("B", "A"), ("B", "C"), ("Q", "Q")], "src string, dst string")
    comps = spark.createDataFrame([(x, x.lower()) for x in "PABCQ"], "id string, name string")
    pages = spark.createDataFrame([("/p", "P"), ("/q", "Q"), ("/none", "Z")], "page string, id string")
    facts = spark.createDataFrame([("C", "call", "/x"), ("P", "state", "s")], "id string, kind string, value string")
    got = {r["page"]: (r["components"], r["direct"], r["facts"]) for r in K.page_components(pages, comps, edges, facts).collect()}
    assert got == {"/p": (["a", "b", "c"], ["a"], ["call:/x", "state:s"]), "/q": ([], [], []), "/none": ([], [], [])}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert K.cyclic_parts(none).count() == 0 and [tuple(r) for r in K.reached(none, spark.createDataFrame([("a",)], "id string")).collect()] == [("a", "a")]
