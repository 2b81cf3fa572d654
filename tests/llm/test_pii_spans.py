"""Base spans, counts and redaction of random texts against regular expressions; many spans in one text."""

import random
import time

from pyspark.sql import functions as F

from strata.llm import pii

from .test_llm import PATTERNS, base_spans, sha

PARTS = ["1.2.3.4", "1.2.3.4011", "10.0.19041.208", "255.255.255.255", "00255.1.1.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (743) 555-3824",
         "+49.30.1234567", "+1", "a.b@c.d", "x@y", "x@y.z.", "q_%@-.-", "@", ".", "-", " ", "  ", "é", "日本", "😀", "\n", "7", "0", "12", "+", "(", ")", "w", "Mail"]


def test_random_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 7))) for _ in range(30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.personal_data(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert r["base_sha256"] == sha(want.encode()), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [kinds.count(k) for k, _ in PATTERNS]


def cover(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        text = "".join(rng.choices("ab é😀", k=rng.choice([0, 1, 9, 700, 1500])))
        spans = sorted((s, rng.randrange(5), min(len(text), s + rng.randint(1, 6))) for s in rng.sample(range(len(text)), min(len(text), rng.choice([0, 1, 3, 600]))))
        rows.append((i, text, spans))
    x = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {r["i"]: r["t"] for r in x.select("i", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: cover(t, s) for i, t, s in rows}


def test_many_spans_take_linear_time(spark):
    text = "a@b.c 1.2.3.4 " * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    docs.count()
    began = time.time()
    r = pii.personal_data(docs).first()
    assert (r["n_email"], r["n_ip"]) == (30_000, 30_000) and time.time() - began < 20
    began = time.time()
    assert pii.redact(docs).first()["text"] == "[EMAIL] [IP] " * 30_000 and time.time() - began < 30
