"""op12: every token once, full windows, the mixture and the carried deficits."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strata.llm import mixture_packing as M

PATH = P.path("word_bpe_49k.json")


def brute_order(sizes, weights):
    """Tokens (queue, i) in the order they are served, one at a time, by exact fractions."""
    from fractions import Fraction

    first = [(Fraction(2 * i + 1, 2 * w), q, i) for q, (n, w) in enumerate(zip(sizes, weights, strict=True)) if w for i in range(n)]
    then = [(Fraction(2 * i + 1, 2 * n), q, i) for q, (n, w) in enumerate(zip(sizes, weights, strict=True)) if not w for i in range(n)]
    return [(q, i) for _, q, i in sorted(first)] + [(q, i) for _, q, i in sorted(then)]


@pytest.mark.parametrize("sizes,weights", [([700, 41, 1, 258], None), ([64, 64, 64], None), ([300, 300, 50], [1, 3, 0]), ([10, 500], [5, 1]), ([5, 9], [0, 0]), ([1], None), ([31, 1, 1, 1, 1, 1], None)])
def test_given_is_the_served_order(sizes, weights):
    weights = weights or sizes
    mix = M.Mixture(sizes, weights, 16)
    order = brute_order(sizes, weights)
    windows = np.arange(len(order) // 16 + 2)
    want = [[sum(q == k for q, _ in order[: 16 * w]) for k in range(len(sizes))] for w in windows]
    assert mix.given(windows).tolist() == want
    for r, (q, i) in enumerate(order):
        assert abs(int(mix.window_of(np.array([q]), np.array([i]))[0]) - r // 16) <= mix.slack


def test_large_queues_lose_no_token():
    sizes = [10**12 + 7, 3 * 10**11, 5, 10**9 + 1]
    mix = M.Mixture(sizes, sizes, 2048)
    w = np.array([0, 1, 10**6, 10**8, sum(sizes) // 2048, sum(sizes) // 2048 + 1])
    b = mix.given(w)
    assert b.sum(axis=1).tolist() == [min(int(x) * 2048, sum(sizes)) for x in w] and (np.diff(b, axis=0) >= 0).all()


def check(rows, got, capacity):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = sorted(tuple([d, *np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tolist()]) for d, t, _ in rows)
    sums = {}
    for r in got:
        sums.setdefault(r["doc_id"], []).append(r)
    for d, ids in [(x[0], x[1:]) for x in want]:
        pieces = [r for r in sums[d] if r["doc_tokens"] == len(ids)]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            if sum(x[0] == d for x in want) == 1:
                assert r["start"] == at
            at = r["start"] + r["length"]
            assert zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    assert sum(r["length"] for r in got) == sum(len(x) - 1 for x in want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at == capacity or at & (at - 1) == 0
    return seqs


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta!", "gamma's", "x1", "😀", "naïve", "<|endoftext|>", "zzz"]
    return [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 900]))), rng.choice(["a", "a", "a", "b", "", None])) for i in range(n)]


@pytest.mark.parametrize("targets", [None, {"a": 1, "b": 5}, {"b": 1}, {}])
def test_round_trip_and_mixture(spark, targets):
    rows = rows_of(1)
    df = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "doc_id long, text string, source string, part int, at int, queue string").repartition(5)
    got = M.mixture_packed(df, PATH, 64, targets=targets).collect()
    check(rows, got, 64)
    if targets is None:
        size, total = {}, sum(r["length"] for r in got)
        for r in got:
            size[r["queue"]] = size.get(r["queue"], 0) + r["length"]
        for w in range(1, total // 64 + 1):
            for q, n in size.items():
                gave = sum(r["length"] for r in got if r["queue"] == q and r["sequence_id"] < w)
                assert abs(gave - w * 64 * n / total) <= 0.5 + len(size) / 2


def test_repeated_null_and_no_rows(spark):
    rows = [(1, "one two", "a")] * 3 + [(None, "three", None), (2, None, None), (2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = M.mixture_packed(df, PATH, 4).collect()
    assert sum(r["length"] for r in got) == 3 * 3 + 2 + 1 + 1 and sum(r["doc_id"] is None for r in got) >= 1
    assert M.mixture_packed(df.limit(0), PATH).count() == 0


def test_wide_ids():
    assert bytes(M.wide(b"\0" + np.array([70000, 1], "<u4").tobytes())) == np.array([70000, 1], "<u4").tobytes()


def test_too_many_queues(spark, monkeypatch):
    monkeypatch.setattr(M, "QUEUES", 2)
    with pytest.raises(ValueError):
        M.mixture_packed(spark.createDataFrame([(i, "x", str(i)) for i in range(3)], "doc_id long, text string, source string"), PATH)
