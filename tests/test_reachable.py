"""Nodes many steps away from the roots."""

from strata.operators import graph


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(67)] + [(67, 0)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "id long")
    assert sorted(r["id"] for r in graph.reachable(edges, roots).collect()) == list(range(68))
