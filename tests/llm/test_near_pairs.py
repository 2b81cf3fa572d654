"""Copies of one text that just miss the threshold: few pairs are listed and no link is lost."""

import random

import numpy as np

from strata.llm import ngram_join as N
from strata.llm.shingles import shingle_set


def edited_copies() -> list[tuple[int, str]]:
    """Copies with two edits, which mostly link, and with three, which link with few of them."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(320):
        words = list(base)
        for at in rng.sample(range(150), 2 if i < 240 else 3):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_few_pairs_of_edited_copies_are_listed(spark, monkeypatch):
    rows = edited_copies()
    sets = [shingle_set(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 7 * both >= 3 * (len(sets[a]) + len(sets[b])):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    told, listed = [], N.candidate_pairs

    def counted(runs, every, *rest):
        pairs = listed(runs, every, *rest)
        if every:
            told.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "candidate_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert told[0] < 600, told  # listed pair by pair they are thousands


def test_wide_pivot_rounds_hold_few_pairs_at_once(monkeypatch):
    monkeypatch.setattr(N, "TOLD", 1_000)
    import pyarrow as pa

    rng = np.random.default_rng(3)
    k = 400
    node = rng.permutation(k).astype(np.int64) + 1
    cols = {"home": np.zeros(k, np.int64), "token": np.zeros(k, np.int64), "node": node, "comp": np.where(np.arange(k) < 200, 0, node), "n": np.full(k, 50), "level": np.ones(k, np.int64), **{c: np.zeros(k, np.int64) for c in N.BIT_COLS}}
    out = list(N.pair_lister(False, 1, 50)(iter([pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()})])))
    assert max(b.num_rows for b in out) <= 1_000
    assert sum(b.num_rows for b in out) == 200 * 50
