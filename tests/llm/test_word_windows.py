"""Scores of words against a brute-force count of word windows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strata.llm import pseudo_likelihood as pl

SCHEMA = "doc_id long, text string"


def brute(texts):
    """log P of each text, from the counts in one process; the network by its own function."""
    tokens = [t.split() for t in texts]
    n = Counter(w for t in tokens for w in t)
    words = sorted(n, key=lambda w: (-n[w], w))
    classes = pl.Classes(words[: pl.WORDS])
    counts = np.zeros(pl.V**3, np.int64)
    for t in texts:
        np.add.at(counts, classes.windows(t), 1)
    table = pl.train(counts).reshape(-1)
    of_class = Counter(classes[w] for t in tokens for w in t)
    windows, contexts = Counter(), Counter()
    around = [list(zip([None, *t[:-1]], t, [*t[1:], None], strict=False)) for t in tokens]
    for t in around:
        windows.update(t)
        contexts.update((a, b) for a, _, b in t)

    def log_p(window, code):
        a, w, b = window
        p0 = math.exp(table[code]) * n[w] / of_class[classes[w]]
        return math.log((windows[window] - 1 + pl.MU * p0) / (contexts[a, b] - 1 + pl.MU))

    return [sum(map(log_p, x, classes.windows(t))) for x, t in zip(around, texts, strict=True)]


@pytest.mark.parametrize("frequent", [65_535, 100])
def test_each_word_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(pl, "FREQUENT", frequent)
    rng = random.Random(4)
    vocab = [f"v{i}x{i % 7}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.randint(1, 120))) for _ in range(150)]
    texts += ["", texts[0], texts[3], "alpha zzqing v1x1", "alpha qqzing v1x1", "alpha qqzing v1x1"]
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[5])]
    got = sorted((r["doc_id"], r["n_tokens"], r["log_likelihood"]) for r in pl.pseudo_likelihood(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = sorted((i, len(t.split()), p) for (i, t), p in zip(rows, brute([t for _, t in rows]), strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-4 * (1 + a[1]) for a, b in zip(got, want, strict=True))
    by_id = {i: p for i, _, p in got}
    # words of one class, ending and shape are told apart
    assert by_id[153] < by_id[154] == by_id[155]
