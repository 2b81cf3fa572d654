"""Rounds of the cycle search on large graphs send nothing through the driver."""

import pytest

from strata.operators import components as CO


@pytest.mark.parametrize("most", [0, 10_000])
def test_cycle_rounds_of_large_graphs_do_not_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(CO, "BROADCAST", most, raising=False)
    told, plain = [], CO.staged
    monkeypatch.setattr(CO, "staged", lambda df, name: told.append("BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    pairs = [(i, (i + 1) % 5) for i in range(5)] + [(10, 11), (11, 10), (4, 10), (11, 12), (7, 7), (20, 21), (21, 22)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(map(tuple, CO.cyclic_parts(edges).collect())) == [(i, 4) for i in range(5)] + [(10, 11), (11, 11)]
    assert any(told) == bool(most)
