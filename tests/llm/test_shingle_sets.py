"""Shingles hashed a batch at a time, and the memory of a pivot round."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import ngram_join, shingles


def plain(text, k=5):
    words = (text or "").encode("utf-8", "surrogatepass").translate(shingles.LOWER).split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("some", [64, 1 << 15])
def test_shingles_of_a_batch(monkeypatch, some):
    monkeypatch.setattr(shingles, "SOME", some)
    rng = np.random.default_rng(3)
    texts = ["", None, " \t\x0b", "a", "A b c\x0cD e f", "x" * 200 + " b c d e", "X" * 200 + "  B\nc d E ", " " * 70 + "ab " * 300, "日本" * 100 + " a b c d e f", "ab ba ab ba ba ab a b"]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 30, n)) for n in rng.integers(1, 90, 60)]
    column = pa.array([None, *texts])[1:]
    known = {}
    for text, h in zip(texts, shingles.shingle_sets(column), strict=True):
        assert len(h) == len(plain(text)) and (h[1:] > h[:-1]).all()
        for other, g in known.items():
            assert len(np.intersect1d(g, h)) == len(plain(other) & plain(text))
        assert h.tolist() == shingles.shingle_set(text).tolist()
        known[text] = h


def test_pivots_leave_in_small_batches():
    lists, sets = 100, 1_500
    rng = np.random.default_rng(5)
    token, node = np.repeat(np.arange(lists), sets), np.concatenate([rng.permutation(10**6)[:sets] for _ in range(lists)])
    cols = {"home": 0 * token, "token": token, "node": node, "comp": node, "n": 0 * token + 400, "level": 0 * token + 1}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in cols.items()})
    tracemalloc.start()
    rows = [b.num_rows for b in ngram_join.pair_lister(False, 0, 6)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(rows) <= 50_000 and sum(rows) > 100_000 and peak < 120e6, (max(rows), peak)
