"""Points of a key with many rows are merged from sorted runs, a bounded part of them at a time."""

import random
from collections import Counter

import pandas as pd
import pytest

from strata.streaming import keyed as K

from .test_held_parts import Handle, Now, Value


class Map:
    def __init__(self):
        self.v = {}

    def getValue(self, key):
        return self.v[key]

    def updateValue(self, key, value):
        self.v[key] = value

    def removeKey(self, key):
        del self.v[key]


class Runs(Handle):
    def getMapState(self, name, key, value):
        return Map()


@pytest.mark.parametrize("alone", [False, True])
def test_growth_takes_a_bounded_part_of_the_held_rows(monkeypatch, alone):
    for name, rows in (("PART", 100), ("RUN", 400), ("PIECE", 10)):
        monkeypatch.setattr(K, name, rows, raising=False)
    rng, handle, p, most, due = random.Random(5), Runs(), K.LatestGrowth(alone), [], K.LatestGrowth.due
    monkeypatch.setattr(K.LatestGrowth, "due", lambda self, key, rows: (most.append(rows.num_rows), due(self, key, rows))[1])
    p.init(handle)
    p.last = Value()
    rows = [(rng.randrange(0, 9_000), rng.randrange(9)) for _ in range(6_000)]
    frame = lambda some: pd.DataFrame({"t": pd.Series(pd.to_datetime([t for t, _ in some], unit="us")), "id": 0, "n": [n for _, n in some], "mark": ""})
    p.handleInputRows(("k",), iter([frame(rows[s : s + 100]) for s in range(0, 6_000, 100)]), None)
    p.handleInputRows(("k",), iter([pd.DataFrame({"t": [pd.NaT], "id": [7], "n": [0], "mark": [None]})]), None)
    got = []
    for passed in (2, 5, 20):
        for x in p.handleExpiredTimer(("k",), Now(passed), Now(handle.at)):
            got += zip(*(x[c].astype("datetime64[us]").astype("int64") for c in ("from_ts", "to_ts")), x["delta"], strict=True)
    often = Counter(t for t, _ in rows)
    points = sorted(r for r in rows if not alone or often[r[0]] == 1)
    assert got == [(t, u, float(m - n)) for (t, n), (u, m) in zip(points, points[1:], strict=False)]
    assert max(most) <= 100 + 15 * 10 + 10 and not p.held.v
