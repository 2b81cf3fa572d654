"""Toxicity by compression distance.

Windows are words in a fixed frame (a marked start and end; words over ``WINDOW`` characters are
several windows). Two dictionaries are trained by zstandard's own trainer: one on ordinary text,
all windows that at least ``SHARED`` of its documents have, the most common last, and one on toxic text, the windows whose character 5-grams are far more
frequent in toxic than in ordinary documents; a window is a training sample as often as documents
have it, up to ``REPEATS``. The trainer drops windows of many samples, so those that are missing whole
are put behind its result, which the format allows. A window's distance is how much shorter it gets with the toxic
dictionary than with the ordinary one, less ``STRICT`` times what the toxic dictionary leaves of
it: full matches stand out from windows that merely share some letters. What the toxic dictionary leaves bounds the distance from above, so the
ordinary dictionary is asked only for the windows that can still decide. A document's largest
distance and its number of positive windows are calibrated to a score by logistic regression.

Labels are read from rows whose crc32(id) mod 5 is not 0, at most ``TOXIC`` toxic and
``ORDINARY`` ordinary ids with the smallest hashes. Those of remainder 4 calibrate, the others make
the dictionaries, near copies among them once; if either part lacks a class, all labelled rows serve
for both. Windows and 5-grams are counted by grouped aggregation; the driver gets the windows of
the dictionaries and two numbers of each calibrating document. Labels, language, source and id
are no inputs of a score. Every whole text is scored.

Defined cases: null text counts as empty; an empty text has no windows and gets the score of the
smallest distance; equal texts get equal scores; repeated rows are each returned; null ids count
as empty text in the remainder and are never labelled; labels other than 0 and 1 are ignored, of
several labels of an id the least counts, and of several texts of an id the one with the
smallest row key; without toxic or without ordinary labels, or without telling 5-grams, all scores
are 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from math import log1p

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, discard, id_and_text, row_key, staged
from .quality import fit_logistic

TOXIC, ORDINARY = 3_000, 9_000
WINDOW, GRAM = 48, 5
#: Ordinary documents that must have a window of the ordinary dictionary; samples of one window at most.
SHARED, REPEATS = 3, 50
STRICT, LOW = 3, -60
#: All frames begin alike, so a match is found only by a deep search: 2**SEARCH places.
SEARCH = 10
#: Bytes of frame and block that zstandard adds to a window that it stores as it is: the most a window can take.
STORED = 9
CACHE, LOCAL = 200_000, 200_000
MARKS = ".,!?;:%$#*&|()[]{}\"'=+@/\\<>~^_`-"


def framed(window: str) -> bytes:
    return ("\n\n\n " + window + " \t\t\t").encode("utf-8", "surrogatepass")


#: A whole window within a dictionary; windows hold no white space, so two of them can't overlap.
WHOLE = re.compile(re.escape(framed("|")).replace(rb"\|", rb"[^ \n\t]+"))


def windows(text: str) -> list[str]:
    return text.lower().split()


def trained(counted: list[tuple[str, int]]) -> bytes:
    """A trained dictionary with the windows that zstandard's trainer left out behind it, the rarest first."""
    samples = [framed(w) for w, n in counted for _ in range(min(n, REPEATS))]
    try:
        made = zs.train_dictionary(max(4_096, 2 * sum(len(framed(w)) for w, _ in counted)), samples).as_bytes()
    except zs.ZstdError:  # too few samples for the trainer
        made = b""
    whole = set(WHOLE.findall(made))
    return made + b"".join(b for w, _ in counted[::-1] if (b := framed(w)) not in whole) or framed("")


class Distance(dict):
    """The distance of a chunk of text, cached; chunks are stripped of marks around them."""

    def __init__(self, toxic: bytes, ordinary: bytes, marked: list[str]):
        def made(b: bytes) -> zs.ZstdCompressor:
            reach = max(10, min(24, len(b).bit_length() + 2))  # all of the dictionary
            log = min(20, reach)
            how = zs.ZstdCompressionParameters(compression_level=3, min_match=3, strategy=zs.STRATEGY_BTOPT, window_log=reach, hash_log=log, chain_log=log, search_log=SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(b), compression_params=how)

        self.toxic, self.ordinary = made(toxic), made(ordinary)
        # a window that the toxic dictionary holds whole
        self.least = min(len(self.toxic.compress(framed(w))) for w in marked)
        self.bounds = Bounds(self)

    def of(self, word: str) -> int:
        b = framed(word)
        return len(self.ordinary.compress(b)) - self.left(b)

    def left(self, b: bytes) -> int:
        t = len(self.toxic.compress(b))
        return t + STRICT * (t - self.least)

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(MARKS)
        if word != chunk and word and len(word) <= WINDOW:
            return self[word]
        d = max(map(self.of, pieces(word)), default=LOW)
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= WINDOW:
            self[chunk] = d
        return d

    def features(self, text: str) -> tuple[float, float]:
        """The largest distance and the number of positive ones; chunks that can change neither are left alone."""
        chunks = list(set(windows(text)))
        bounds = list(map(self.bounds.__getitem__, chunks))
        first = self[chunks[bounds.index(max(bounds))]] if chunks else LOW
        floor = min(max(first, LOW), 0)
        found = [self[c] for c, most in zip(chunks, bounds, strict=True) if most > floor]
        return float(max(LOW, first, *found)), log1p(sum(d > 0 for d in found))


class Bounds(dict):
    """The most that the distance of a chunk can be, by the toxic dictionary alone; cached."""

    def __init__(self, distance: Distance):
        self.distance = distance

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(MARKS)
        if word != chunk and word and len(word) <= WINDOW:
            return self[word]
        most = max((len(b) + STORED - self.distance.left(b) for b in map(framed, pieces(word))), default=LOW)
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= WINDOW:
            self[chunk] = most
        return most


def pieces(word: str) -> list[str]:
    """The windows of a word."""
    return [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]


def grams(word: str) -> set[str]:
    w = f"_{word}_"
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def signs(chunks: list[str]) -> list[int]:
    """Four hashes that near copies are likely to share."""
    return nsmallest(4, {zlib.crc32(" ".join(chunks[i : i + 4]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(chunks) - 3))})


def words_of(sample: DataFrame) -> DataFrame:
    """doc_id, y, signs and distinct windows of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                chunks = [windows(t.as_py()) for t in part.column(2)]
                words = [sorted({w for x in set(c) for w in pieces(x.strip(MARKS))}) for c in chunks]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(signs, chunks), pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "y", "signs", "words"])

    return sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, signs array<long>, words array<string>")


def gram_counts(kept: DataFrame) -> DataFrame:
    """(gram, a, b): toxic and ordinary documents that have a 5-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class: tuple[Counter, Counter] = (Counter(), Counter())

        def counted():
            for y, c in enumerate(by_class):
                n, z = pa.array(list(c.values()), pa.int64()), pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((n, z) if y else (z, n))], names=["gram", "a", "b"])
                c.clear()

        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_class[y].update(set().union(*map(grams, words.as_py())))
                if len(by_class[0]) + len(by_class[1]) > LOCAL:
                    yield from counted()
        yield from counted()

    return kept.select("y", "words").mapInArrow(run, "gram string, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def telling(n_ordinary: int, n_toxic: int) -> Column:
    """Whether a 5-gram is far more frequent in toxic documents."""
    a, b = F.col("a"), F.col("b")
    expected = F.lit(n_toxic / (n_toxic + n_ordinary)) * (a + b)
    return (a >= max(4.0, 0.02 * n_toxic)) & (a / n_toxic >= 8 * (b + 0.5) / n_ordinary) & ((a - expected) / F.sqrt(expected) > 4)


def chosen_windows(sample: DataFrame) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """The windows of both dictionaries with the number of documents that have them; both empty without a class or signs."""
    words = staged(words_of(sample), "toxicity_words")
    # a document goes if a lesser one shares a sign with it
    sign = words.select("doc_id", F.explode("signs").alias("sign"))
    later = sign.join(sign.groupBy("sign").agg(F.min("doc_id").alias("first")), "sign").filter("first < doc_id").select("doc_id").distinct()
    kept = words.join(later, "doc_id", "left_anti")
    n = dict.fromkeys((0, 1), 0) | {r["y"]: r["n"] for r in bounded_rows(kept.groupBy("y").agg(F.count(F.lit(1)).alias("n")), 2)}
    found: tuple[list, list] = ([], [])
    if n[0] and n[1]:
        counts = staged(kept.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")), "toxicity_counts")
        signs_of = gram_counts(kept).filter(telling(n[0], n[1])).select("gram")
        padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
        pieces = counts.filter((F.col("n1") > 0) & (F.length("word") + 2 >= GRAM)).select("word", "n1", F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: padded.substr(i, F.lit(GRAM)))).alias("gram"))
        marked = pieces.join(signs_of, "gram", "left_semi").select("word", "n1").distinct()
        # windows of at most TOXIC + ORDINARY labelled texts
        top = lambda df, by: [(r["word"], r[by]) for r in df.orderBy(F.desc(by), "word").collect()]
        found = top(marked, "n1"), top(counts.filter(F.col("n0") >= SHARED), "n0")
        discard(counts)
    discard(words)
    return found if found[0] else ([], [])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = id_and_text(docs, id_col, text_col)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(fold != 0)
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"))
    pick = lambda y, most: marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = staged(pick(1, TOXIC).unionByName(pick(0, ORDINARY)), "toxicity_labels")
    texts = staged(rows.join(F.broadcast(some), "doc_id").withColumn("at", row_key()), "toxicity_texts")  # at most TOXIC + ORDINARY ids
    sample = texts.join(texts.groupBy("doc_id").agg(F.min("at").alias("at")), ["doc_id", "at"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text", "y", fold.alias("fold"))
    calibrates = F.col("fold") == 4
    parts = bounded_rows(sample.groupBy(calibrates.alias("c"), "y").count(), 4)
    both = len(parts) == 4
    toxic, ordinary = chosen_windows(sample.filter(~calibrates) if both else sample)
    model = (trained(toxic), trained(ordinary), [w for w, _ in toxic]) if toxic else None

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*model)
        for batch in batches:
            x = np.array([distance.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T)], names=["y", "far", "many"])

    if model:
        points = sample.filter(calibrates) if both else sample
        x = np.array(sorted(bounded_rows(points.select("y", "text").mapInArrow(measured, "y int, far double, many double"), TOXIC + ORDINARY)))
        mean, dev, w = fit_logistic(x[:, 1:], x[:, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*model) if model else None
        for batch in batches:
            if distance is None:
                score = np.zeros(batch.num_rows)
            else:
                x = np.array([distance.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
                score = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / dev) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    discard(texts, some)
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
