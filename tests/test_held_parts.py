"""Rows that a stream holds go to the state in parts, and come back in order."""

import random

import pandas as pd

from strata.streaming import keyed as K


class Value:
    def __init__(self):
        self.v, self.values = None, []

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v if self.v is not None else iter(self.values)

    def update(self, v):
        self.v = v

    def clear(self):
        self.v, self.values = None, []

    def appendList(self, more):
        self.values = self.values + more

    def put(self, values):
        self.values = list(values)


class Handle:
    def getListState(self, name, schema):
        return Value()

    getValueState = getListState

    def registerTimer(self, ms):
        self.at = ms

    def deleteTimer(self, ms):
        self.at = None


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_held_rows_are_few_values_and_hits_are_those_of_a_walk(monkeypatch):
    monkeypatch.setattr(K, "PART", 300, raising=False)
    rng, handle, p = random.Random(2), Handle(), K.CacheHits(50_000)
    p.init(handle)
    rows = [(rng.randrange(0, 4_000_000), i) for i in range(2_000)]
    frame = lambda some: pd.DataFrame({"t": pd.Series(pd.to_datetime([t for t, _ in some], unit="us")), "id": [i for _, i in some], "n": 0, "mark": ""})
    p.handleInputRows(("k",), iter([frame(rows[s : s + 100]) for s in range(0, 2_000, 100)]), None)
    p.handleInputRows(("k",), iter([pd.DataFrame({"t": [pd.NaT], "id": [7], "n": [0], "mark": [None]})]), None)
    assert len(list(p.held.get())) == 7
    out = []
    for passed in (1_500, 2_500, 9_000):
        fire, told = Now(handle.at), Now(passed)
        out += [t for x in p.handleExpiredTimer(("k",), told, fire) for t in zip(x["t"].astype("datetime64[us]").astype("int64"), x["id"], x["hit"], strict=True)]
    want, last = [], None
    for t, i in sorted(rows):
        hit = last is not None and t - last < 50_000
        last = last if hit else t
        want.append((t, i, hit))
    assert out == want and not list(p.held.get())
