"""The windows of the toxicity dictionaries against counts in one process, and awkward labels."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strata.llm import toxicity as tx

RUDE = ["numbskull", "dunderhead", "nincompoop"]


def fixture(n=400):
    rng, rows = random.Random(2), []
    for i in range(n):
        w = [f"w{rng.randint(0, 300)}" for _ in range(50)]
        if i % 5 == 0:
            w[rng.randrange(50)] = rng.choice(RUDE) + rng.choice(["", "!", "s,"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return [*rows, (n, rows[7][1] + " more", 0), (n + 1, rows[5][1] + " more", 1)]


def brute(rows):
    kept, first = [], {}
    for i, t, y in rows:
        for s in tx.signs(tx.windows(t)):
            first[s] = min(i, first.get(s, i))
    for i, t, y in rows:
        if all(first[s] >= i for s in tx.signs(tx.windows(t))):
            kept.append((y, {w for x in tx.windows(t) for w in tx.pieces(x.strip(tx.MARKS))}))
    n = Counter(y for y, _ in kept)
    by = [Counter(g for y, w in kept if y == c for g in set().union(*map(tx.grams, w))) for c in (0, 1)]

    def tells(g):
        a, b = by[1][g], by[0][g]
        expected = n[1] * (a + b) / (n[0] + n[1])
        return a >= max(4, 0.02 * n[1]) and a / n[1] >= 8 * (b + 0.5) / n[0] and (a - expected) / expected**0.5 > 4

    words = [Counter(x for y, w in kept if y == c for x in w) for c in (0, 1)]
    top = lambda c: sorted(c.items(), key=lambda i: (-i[1], i[0]))
    return top({x: m for x, m in words[1].items() if any(map(tells, tx.grams(x)))}), top({x: m for x, m in words[0].items() if m >= tx.SHARED})


def test_windows(spark):
    rows = fixture()
    got = tx.chosen_windows(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3))
    assert (got[0], got[1]) == brute(rows) and {w for w, _ in got[0]} >= set(RUDE)


def test_long_words_are_several_windows(spark):
    rows = [(i, "z" * 100 + f" own{i} word", 0) for i in range(3)] + [(9, "short words", 1)]
    got = {r["doc_id"]: r["words"] for r in tx.words_of(spark.createDataFrame(rows, "doc_id long, text string, y int")).collect()}
    assert got[0] == sorted(["z" * 48, "z" * 4, "own0", "word"]) and got[9] == ["short", "words"] and tx.trained([])


def test_scores(spark):
    """Scores by plain Python: dictionaries of the windows, features, logistic regression."""
    rows = fixture()
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows}
    known = [r for r in rows if fold[r[0]]]
    two = len({(fold[i] == 4, y) for i, _, y in known}) == 4
    toxic, ordinary = brute([r for r in known if fold[r[0]] != 4 or not two])
    d = tx.Distance(tx.trained(toxic), tx.trained(ordinary), [w for w, _ in toxic])
    x = np.array(sorted((float(y), *d.features(t)) for i, t, y in known if fold[i] == 4 or not two))
    mean, dev, w = tx.fit_logistic(x[:, 1:], x[:, 0])
    want = {i: 1 / (1 + np.exp(-np.clip(w[0] + ((np.array(d.features(t)) - mean) / dev) @ w[1:], -30, 30))) for i, t, _ in rows}
    got = tx.toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["held_out"] == (fold[r["doc_id"]] == 0) and r["predicted"] == int(r["score"] >= 0.5)


def test_dictionary_windows_match():
    words = [(f"{a}{b}word", 20) for a in ("brown", "green", "violet", "amber") for b in range(60)]
    d = tx.Distance(tx.trained(words), tx.trained([(f"plain{i}", 9) for i in range(300)]), [w for w, _ in words])
    assert sum(d[w] > 0 for w, _ in words) >= 0.9 * len(words) and d["plain7"] < 0


def test_labels(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, RUDE[0]), (None, None), (3, "again"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 7), (2, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels)
    assert got.count() == docs.count() and got.filter("doc_id is null and predicted = 1").count() == 1
    assert got.filter(F.col("doc_id") == 3).select("score").distinct().count() == 2
    assert tx.toxicity(docs, labels.filter("toxic = 0")).filter("score <> 0").count() == 0


def test_bounds_change_no_feature():
    rng = random.Random(5)
    words = [(f"{a}{b}word", 20) for a in ("brown", "green") for b in range(40)]
    d = tx.Distance(tx.trained(words), tx.trained([(f"plain{i}", 9) for i in range(300)]), [w for w, _ in words])
    some = [w for w, _ in words] + [f"plain{i}" for i in range(300)] + ["".join(chr(rng.choice((97, 122, 233, 20013, 128512)) + rng.randint(0, 3)) for _ in range(rng.randint(1, 120))) for _ in range(500)]
    assert all(d.bounds[w] >= d[w] for w in some)
    for n in (0, 1, 3, 40, 400):
        text = " ".join(w + rng.choice(["", "!", '",']) for w in rng.choices(some, k=n))
        found = [d[w] for w in set(tx.windows(text))]
        assert d.features(text) == (float(max([tx.LOW, *found])), np.log1p(sum(x > 0 for x in found)))


def test_windows_that_the_trainer_left_out_are_added():
    words = [(f"{a}{b}word", b % 7 + 1) for a in ("brown", "größe", "\U0001f600", "|a.b*") for b in range(80)]
    made = tx.zs.train_dictionary(max(4_096, 2 * sum(len(tx.framed(w)) for w, _ in words)), [tx.framed(w) for w, n in words for _ in range(n)]).as_bytes()
    assert tx.trained(words) == made + b"".join(tx.framed(w) for w, _ in words[::-1] if tx.framed(w) not in made)
    assert all(tx.framed(w) in tx.trained(words) for w, _ in words)
