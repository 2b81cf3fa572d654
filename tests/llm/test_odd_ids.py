"""Near duplicates and the quality filter on null ids, repeated rows and one id with several texts, against brute force."""

import random

from strata.llm import ngram_join, quality

SCHEMA = "doc_id long, text string, lang string, source string"


def shingles(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Indexes of rows by component."""
    sets, up = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    return sets, [find(i) for i in range(len(rows))]


def awkward(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 8, 30, 90, 200]))] for _ in range(25)]
    rows = [(5, "alone x y z 1 2 3 4 5 6 7 8 9"), (None, None), (None, ""), (3, " ")]
    for i in range(260):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            x[rng.randrange(len(x))] = f"e{rng.randint(0, 9)}"
        text = " ".join(x[rng.choice([0, 0, 3]) :])
        rows.append((rng.choice([None, 7, 7, i, i, i, i]), text.upper() if rng.random() < 0.1 else text))
    return rows + rows[10:20]


def test_components(spark):
    for seed in (2,):
        rows = awkward(seed)
        sets, of = groups(rows)
        least = {}
        for (i, _), g in zip(rows, of, strict=True):
            least[g] = min((i is None, i or 0), least.get(g, (True, 0)))
        want = sorted(((i, len(s), (None if least[g][0] else least[g][1]) if s else i) for (i, _), s, g in zip(rows, sets, of, strict=True)), key=str)
        docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)
        assert sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=str) == want
        kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(docs).collect()]
        full = [(i, t) for i, t in kept if shingles(t or "")]
        index = {}
        for (i, t), g in zip(rows, of, strict=True):
            index.setdefault((i, t), set()).add(g)
        shown = [g for row in full for g in index[row]]
        assert sorted(shown) == sorted(set(of) - {g for g, s in zip(of, sets, strict=True) if not s})
        assert all((i is None, i or 0) == least[next(iter(index[i, t]))] for i, t in full)
        assert len(kept) - len(full) == sum(not s for s in sets)


def test_names_that_clash(spark, monkeypatch):
    real = ngram_join.set_key
    monkeypatch.setattr(ngram_join, "set_key", lambda h, salt: (int(real(h, salt)[0] % 3) if salt == 1 else real(h, salt)[0], real(h, salt)[1]))
    docs = spark.createDataFrame([(i, f"t{i} a b c d e f g", "en", "s") for i in range(9)], SCHEMA)
    assert sorted(r["component_id"] for r in ngram_join.near_duplicates(docs).collect()) == list(range(9))


def test_nothing_is_left_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    ngram_join.near_duplicates(spark.createDataFrame([(1, "a b c d e f", "en", "s"), (2, "a b c d e f g", "en", "s")], SCHEMA)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_quality_by_row(spark):
    good = "some calm words that make a sentence of fair length. "
    rows = [(i, good * (1 + i % 3) + f"n{i}") if i % 4 else (i, "BUY!! NOW!! $$$ " * (20 + i)) for i in range(120)]
    rows += [(None, "BUY!! NOW!! $$$ " * 25), (None, good + "n7"), (1, "WIN!! NOW!! $$$ " * 30), (1, good + "n1"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 120, 3)] + [(3, 2), (6, None), (None, 1), (9, 1), (9, 0)], "doc_id long, quality int")
    kept = {(r["doc_id"], r["text"]) for r in quality.keep_good(docs, labels).collect()}
    assert (None, good + "n7") in kept and not any(t and "!!" in t for _, t in kept) and (1, good + "n1") in kept
    odd = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, quality int")
    assert quality.keep_good(docs, odd).count() == len(rows)
    assert quality.quality_scores(docs, labels).count() == len(rows)
