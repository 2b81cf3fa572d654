"""op6 and op9 against plain Python: features, posteriors, anchors, likeness; op3, op4 and op9 on null ids and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import byte_bpe, packing, quality, syncmers

KIND = "doc_id long, text string, lang string, source string, at string, salt int, part int, key string, n long"


def rows_of(seed, n=160):
    rng = random.Random(seed)
    good = ["the", "river", "was", "calm", "and", "old", "people", "spoke", "of", "it,", "often."]
    out = []
    for i in range(n):
        bad = rng.random() < 0.4
        words = [rng.choice(["$$", "WIN", "99", "WIN", "{}"] if bad else good) for _ in range(rng.choice([1, 5, 40]))]
        out.append((i, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), "x", 1, 2, "k", 3))
    out += [(n, None, "en", "a", "x", 1, 2, "k", 3), (n + 1, "", "en", "a", "x", 1, 2, "k", 3), (n + 2, "word " * 30_000, "en", "b", "x", 1, 2, "k", 3), (None, "the river", "en", "b", "x", 1, 2, "k", 3)]
    labels = [(i, int("WIN" not in (t or "") and "$$" not in (t or ""))) for i, t, *_ in out if i is not None and i % 2]
    return out + out[:6], labels


def features(t):
    n, w = max(len(t), 1), quality_words(t)
    k = max(len(w), 1)
    share = lambda chars: sum(c in chars for c in t) / n
    return [share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ"), share("!#$%&*|<>{}[]=_~^"), share("0123456789"), len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, math.log1p(n / k), math.log1p(k), share(".,;:?")]


def quality_words(t):
    import re

    return re.split(r"\s+", t)


def posteriors(rows, labels):
    """Score of each row by the definitions: logistic evidence, then host and path rates without the row itself."""
    x = np.array([features(t or "") for _, t, *_ in rows])
    y = dict(labels)
    seen = {}
    for j, (i, *_) in enumerate(rows):
        if i in y:
            seen.setdefault(i, j)
    at = list(seen.values())
    mean, dev, w = quality.fit_logistic(x[at], np.array([y[rows[j][0]] for j in at], float))
    rate = np.mean([y[rows[j][0]] for j in at])
    prior = math.log(rate / (1 - rate))
    evidence = ((x - mean) / dev) @ w[1:] + w[0] - prior
    p = 1 / (1 + np.exp(-(evidence + prior)))
    host, path = [r[3] for r in rows], [(r[3], r[2]) for r in rows]

    def tally(keys):
        n, s = Counter(keys), Counter()
        for k, v in zip(keys, p, strict=True):
            s[k] += v
        return n, s

    def strength(n, s):
        total = sum(n.values())
        mu = sum(s.values()) / total
        within = mu * (1 - mu)
        between = max(0.0, (sum(s[k] ** 2 / n[k] for k in n) - total * mu * mu - (len(n) - 1) * within) / total)
        return mu, min(1e4, max(1.0, within / between - 1)) if between > 1e-12 else 1e4

    (hn, hs), (pn, ps) = tally(host), tally(path)
    mu, a = strength(hn, hs)
    _, b = strength(pn, ps)
    out = []
    for j in range(len(rows)):
        h = (hs[host[j]] + a * mu) / (hn[host[j]] + a)
        rest = min(max((ps[path[j]] - p[j] + b * h) / (pn[path[j]] - 1 + b), 1e-6), 1 - 1e-6)
        out.append((evidence[j], h, rest, 1 / (1 + math.exp(-(evidence[j] + math.log(rest / (1 - rest)))))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors(spark, seed):
    rows, labels = rows_of(seed)
    got = quality.quality_scores(spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert got.columns == ["doc_id", "evidence", "host_rate", "path_rate", "score", "accepted"]
    shown = lambda r: (-1 if r[0] is None else r[0], *(round(v, 6) for v in r[1:5]))
    want = sorted((shown((r[0], *v)) for r, v in zip(rows, posteriors(rows, labels), strict=True)))
    have = sorted(shown(r) for r in got.collect())
    assert len(have) == len(want) and [r[0] for r in have] == [r[0] for r in want]
    assert np.allclose([r[1:] for r in have], [r[1:] for r in want], atol=2e-5)


def anchors(spark, t):
    """Closed syncmers by the definition; only the hashes come from Spark."""
    words = [w for w in t.replace("\t", " ").split(" ")] if t.strip() else []
    one = lambda *v: spark.range(1).select(F.xxhash64(*map(F.lit, v))).first()[0]
    out = []
    if len(words) >= syncmers.K:
        pairs = [one(a, b) for a, b in zip(words, words[1:], strict=False)]
        for i in range(len(words) - syncmers.K + 1):
            inner = pairs[i : i + syncmers.K - 1]
            if min(inner) in (inner[0], inner[-1]):
                out.append(one(*inner) & 0xFFFFFFFF)
    return out or ([one(t) & 0xFFFFFFFF] if t else [])


def test_anchors_and_likeness(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(n)) for n in (0, 3, 8, 14, 22)]
    texts.append(texts[-1] + " tail")
    rows = [(i, t, None, None, "x", 1, 2, "k", 3) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(spark.createDataFrame(rows, KIND).repartition(2)).collect()}
    marks = [anchors(spark, t) for t in texts]
    for i, m in enumerate(marks):
        assert got[i]["fingerprint"] == "".join(f"{a:08x}" for a in m)
        after = marks[i - 1]  # the next document by descending id; after the last the first
        total = len(set(m)) + len(set(after))
        assert got[i]["near_next"] == pytest.approx(1.0 if not total else 2 * len(set(m) & set(after)) / total)


def odd_rows():
    texts = ["one two three", "", None, "lorem ipsum " * 400, "é 😀", "one two three"]
    rows = [(None if i % 3 == 0 else 7 + i % 2, t, None, None, "x", 1, 2, "k", 3) for i, t in enumerate(texts)]
    return rows + rows[:3]


def test_null_ids_and_repeated_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, KIND).repartition(4)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.packed_sequences(df, P.path("word_bpe_49k.json"), 64).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows]
    want = Counter((rows[k][0], j, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for k, x in enumerate(ids) for j, s in enumerate(range(0, len(x), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 64
    path = P.path("byte_bpe_multi_50k.tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in byte_bpe.encoded(df, path, P.PATTERN).collect())
    assert got == Counter((i, len(x), sha(x)) for i, x in ((i, enc.encode_ordinary(t or "")) for i, t, *_ in rows))
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    edited = Counter()
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in syncmers.fingerprints(df).collect()) == edited
