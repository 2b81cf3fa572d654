"""Links that near-duplicate candidates must keep."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from strata.llm import ngram_join


def exhaustive(monkeypatch):
    """The function that candidate_pairs(every=True) maps over record batches."""

    class Runs:
        sparkSession = None

        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    monkeypatch.setattr(ngram_join, "shuffle_width", lambda spark: 1)
    return ngram_join.candidate_pairs(Runs(), True).run


@pytest.mark.parametrize("longer", [False, True])
def test_exhaustive_round_keeps_links(spark, monkeypatch, longer):
    run, rng, links, differ = exhaustive(monkeypatch), np.random.default_rng(11), 0, 0
    for n in range(30, 401, 2):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a, rng.integers(0, 2**64, n // 8, dtype=np.uint64)))) if longer else a[n // 8 :]
        assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        bits = [np.asarray(ngram_join.parities(x)).view(np.int64) for x in (a, b)]
        differ += bool(((bits[0] ^ bits[1]) < 0).any())
        one = lambda v: pa.array(np.array(v, np.int64))
        cols = [one([1, 1]), one([7, 7]), one([1, 2]), one([1, 2]), one([len(a), len(b)]), one([0, 0]), one([1, 1]), one([0, 0]), *(one([p, q]) for p, q in zip(*bits, strict=True))]
        batch = pa.RecordBatch.from_arrays(cols, names=["home", "token", "node", "comp", "n", "pos", "level", "rank", *ngram_join.BIT_COLS])
        links += sum(len(x) for x in run(iter([batch])))
    assert links == len(range(30, 401, 2)) and differ > 30


def test_folded_bitmaps_keep_links():
    rng = np.random.default_rng(4)
    for n in (1, 2, 120, 130, 500, 2100, 40_000):
        for drop in (0, n // 9, n // 7):
            base = np.unique(rng.integers(0, 2**64, n + drop, dtype=np.uint64))
            a, b = base[drop:], base
            p, q = (ngram_join.parities(x, ngram_join.wide_bits(len(x))) for x in (a, b))
            assert ngram_join.differing(p, q) == ngram_join.differing(q, p) <= len(np.setxor1d(a, b))
            if len(p) < len(q):
                assert ngram_join.differing(p, q) == ngram_join.differing(p, ngram_join.parities(b, 64 * len(p)))
    x, y = (rng.integers(0, 2**64, 3000, dtype=np.uint64) for _ in "ab")
    assert 7 * ngram_join.differing(*(ngram_join.parities(s, ngram_join.wide_bits(3000)) for s in (x, y))) > 6000


def large_group(lists: int, sets: int) -> pa.RecordBatch:
    """Lists of one home that all hold the same sets, each set a component of its own."""
    token, node = np.repeat(np.arange(lists), sets), np.tile(np.arange(sets), lists)
    flat = lambda v: np.full(lists * sets, v)
    cols = [flat(1), token, node, node, flat(400), flat(0), flat(1), flat(0), *(flat(0) for _ in ngram_join.BIT_COLS)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["home", "token", "node", "comp", "n", "pos", "level", "rank", *ngram_join.BIT_COLS])


def test_pairs_of_a_large_group_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOLD", 50_000, raising=False)
    run, batch = exhaustive(monkeypatch), large_group(20, 600)
    tracemalloc.start()
    total, distinct, pairs = 0, 0, set()
    for b in run(iter([batch])):
        total += pc.sum(b.column(3)).as_py()
        distinct += b.num_rows
        pairs.update((b.column(0).to_numpy() * 1000 + b.column(1).to_numpy()).tolist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 20 * len(pairs) == 20 * 600 * 599 // 2
    assert distinct == len(pairs) and peak < 60e6  # of this the set of pairs takes a third
