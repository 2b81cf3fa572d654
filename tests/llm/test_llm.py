"""The corpus operators against brute force, on a fixture of awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from strata.llm import archive_io, exact_dedup, ngram_join, packing, pii, pseudo_likelihood, quality, syncmers, toxicity, warc
from strata.llm.byte_bpe import ByteBpe, GrowingText, encoded
from strata.llm.word_tokens import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, digest string, node long, words int"
random.seed(5)
VOCAB = [f"w{i}" for i in range(300)]
LONG = " ".join(random.choice(VOCAB) for _ in range(6000))
BASE = [random.choice(VOCAB) for _ in range(80)]


def near(k):
    x = list(BASE)
    x[k] = "edited"
    return " ".join(x)


TEXTS = [None, "", " \n\t ", "one two", "One TWO", "a b c d e", "a b c d e", LONG, LONG, "mail me.now@x-y.example.com or +1 (743) 555-3824, ip 10.0.0.1 999.1.1.1 card 4111 1111 1111 1111 4111 1111 1111 1112",
         "é 😀 日本 x@y.z a@b.c_q@d.e 1.2.3.4.5.6.7.8", "a" * 5000, "a.b." * 2000 + "@", "1 " * 3000, *(near(k) for k in range(12)), "IDIOT! you 'idiot' scum", "+1234567890 +1", "token = \"24be64439e3e49cf46b2d7c90f3602a3\""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", None if i == 3 else "s", None, 1, "d", 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {i * 3: t or "" for i, t in enumerate(TEXTS)}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact(docs, none):
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, keep="largest", runs=8, fan_in=2).collect()}
    for i, t in texts().items():
        same = [k for k, v in texts().items() if v == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), i == max(same), sha(t.encode()))
    kept = exact_dedup.drop_exact_duplicates(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == len(set(texts().values()))
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_near(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts().items()}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.near_duplicates(none).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        return k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 12 <= len(d) <= 19 and total % 10 == 0 or k == "phone" and 9 <= len(d) <= 15

    found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if good(k, m[0]))
    return ",".join(f"{PATTERNS[i][0]}:{s}:{e}" for s, i, e in found)


def test_pii(docs, none):
    for r in pii.personal_data(docs).collect():
        want = base_spans(texts()[r["doc_id"]])
        assert r["base_sha256"] == sha(want.encode()), r["doc_id"]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert all(not base_spans(r["text"] or "") for r in clean.collect())
    assert clean.filter("text is null").count() == 1 and pii.redact(none).count() == pii.personal_data(none).count() == 0


def test_packing(docs, none):
    path = P.path("word_bpe_49k.json")
    tok = WordEncoder(path)
    ids = {i: np.frombuffer(tok.whole(t), "<u4").tolist() + [0] for i, t in texts().items()}
    rows = packing.packed_sequences(docs, path, 256).collect()
    seqs = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.packed_sequences(none, path).count() == 0
    counts = np.zeros(17, int)
    counts[[5, 6, 7, 9]] = [3, 2, 4, 1]
    used = np.zeros(17, int)
    for times, here in packing.best_two_fit(counts, 16):
        assert sum(here) <= 16
        for s in here:
            used[s] += times
    assert (used == counts).all()


def test_byte_bpe(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = ByteBpe.of(path, P.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for r in encoded(docs, path, P.PATTERN).collect():
        t = texts()[r["doc_id"]]
        ids = lib.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))
    assert encoded(none, path, P.PATTERN).count() == 0
    rng, alphabet = random.Random(1), "ab é\n 's.!1日 \t"
    for _ in range(200):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        g = GrowingText(bpe, x)
        for _ in range(3):
            s = rng.randint(0, len(x))
            e = rng.randint(s, min(len(x), s + 5))
            new = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
            x = x[:s] + new + x[e:]
            g.replace(s, e, new)
            assert g.ids() == lib.encode_ordinary(x)


def test_fingerprints(docs, none):
    order = sorted(texts(), reverse=True)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    prints = {}
    for k, i in enumerate(order):
        t, after = texts()[i], texts()[order[(k + 1) % len(order)]]
        h = len(t) // 2
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha((t[: len(t) - h] + after[:h]).encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert syncmers.fingerprints(none).count() == 0


def test_warc(spark, none):
    pages = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\nWARC/1.0")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r for r in warc.warc_round_trip(df).collect()}
    bodies = {i: (h or "").encode() for i, _, h in pages}
    for i, b in bodies.items():
        top = max(k for k, v in bodies.items() if v == b)
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    for v in (1, 2):
        data = archive_io.arc_file_header("n", v, "20240101") + archive_io.arc_record(v, "n", 0, "http://x", "2024", b"abc")
        assert [(r.url, r.block) for r in archive_io.parse_arc(data)] == [("http://x", b"abc")]
        with pytest.raises(ValueError):
            list(archive_io.parse_arc(data[:-3]))


def test_quality(spark, none):
    rows = [(i, " ".join(random.choice(VOCAB) for _ in range(60)) if i % 4 else "BUY!! NOW!! " * 30, "en", f"s{i % 3}", 0, 1, "", 0, 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 3)], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i in range(200) if i % 4}
    assert quality.keep_good(docs, labels.limit(0)).count() == 200 and quality.keep_good(none, labels).count() == 0


def test_toxicity(spark, docs, none):
    rude = ["numbskull", "dunderhead", "nincompoop"]
    rows = []
    for i in range(400):
        w = [random.choice(VOCAB) for _ in range(50)]
        if i % 5 == 0:
            w[random.randrange(50)] = rude[i % 3]
        rows.append((i, " ".join(w)))
    x = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(x, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.95
    other = toxicity.toxicity(docs, labels).collect()
    assert len(other) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in other)
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_pseudo_likelihood(docs, none):
    got = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["log_likelihood"] == 0
    assert got[21]["log_likelihood"] == got[24]["log_likelihood"] < 0 and got[21]["n_tokens"] == 6000
    counts = np.zeros(pseudo_likelihood.V**3, np.int64)
    codes = pseudo_likelihood.Classes(["a", "b"]).windows("a b a b a b")
    np.add.at(counts, codes, 100)
    table = pseudo_likelihood.train(counts).reshape(-1)
    assert np.allclose(np.exp(table.reshape(96, 96, 96)).sum(axis=1), 1, atol=1e-3) and table[codes].mean() > -0.5
    assert pseudo_likelihood.pseudo_likelihood(none).count() == 0


def test_pipeline_takes_effect(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 8 not in ids and 7 in ids and sum(i in ids for i in range(14, 26)) == 1
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_bitmaps_keep_links():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 300, 3000):
        for drop in (0, n // 9, n // 7, n // 4):
            base = np.unique(rng.integers(0, 2**63, n + drop).astype(np.uint64))
            a, b = base[: len(base) - drop], base[drop:]
            differ = int(np.bitwise_count(ngram_join.parities(a) ^ ngram_join.parities(b)).sum())
            assert differ <= len(np.setxor1d(a, b))
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                assert 7 * differ <= len(a) + len(b)
