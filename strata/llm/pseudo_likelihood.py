"""Masked pseudo-likelihood of documents: a bidirectional window network over words of the corpus.

Tokens are the words of the corpus, all of them. A token's probability given both neighbours is

    P(w | l, r) = (c(l, w, r) - 1 + MU P0(w | l, r)) / (c(l, ., r) - 1 + MU)

with the counts of word windows over the whole corpus, the token's own occurrence left out, and
P0(w | l, r) = P(class of w | classes of l and r) n(w) / n(class of w). The class probability is
that of a network with one hidden layer over ``V`` classes (frequent words, the others by shape
and ending), which is trained in numpy on the counts of class windows, at most V**3 of them.

The vocabulary, its counts and the word windows are never on one machine. (1) A pass counts words;
the FREQUENT most frequent ones are broadcast with their counts, which saves shuffling and changes
no result. (2) A pass counts the class windows, and the windows within the TOP words, which are
too common for one task. (3) A pass sends all occurrences to their context (to their window where the
context lies within the TOP words), packed per bucket; the number of buckets grows with the corpus.
(4) Occurrences of words that were not broadcast go on to their word, where n(w) is counted. (5) The
parts of the documents that a task held together meet. Log-probabilities are summed as integers of 1/SCALE, so sums don't depend on the order of rows.

Defined cases: null and empty texts have no tokens, log-likelihood 0 and 0 per token; the border
of a text is a class of its own; equal texts get equal scores; repeated rows count and are
returned each; ties among frequent words go to the smaller word; an empty table gives an empty
result; null ids are scored like others; further columns are ignored. Contexts, windows within a
bucket, and words beyond FREQUENT are told apart by hashes of 63, 64 and 56 bits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, id_and_text, shuffle_width, staged
from .shingles import mixed

#: Classes: the border, frequent words, shapes and endings.
V, WORDS = 96, 47
#: Words whose counts a task holds before it hands them on.
LOCAL = 400_000
HIDDEN, STEPS = 24, 200
CACHE = 250_000
MARKS = ".,!?;:%$#*&|()[]{}\"=+@/\\<>~^_`-"
SHAPES = 4  # marks at the end, capitals, digits, no letters
#: Words that are broadcast with their counts; of them, those whose windows are counted densely.
FREQUENT, TOP = 65_535, 64
#: The weight of P0 against counted windows.
MU = 4.0
SCALE = 2**20
#: Tokens that a task packs at once, and that a bucket holds on average.
PACK, BUCKET = 500_000, 1_500_000
U = np.uint64
RARE = 1 << 63


class Classes(dict):
    """The class of a chunk; 0 is the border, 1..WORDS are frequent words."""

    def __init__(self, words: list[str]):
        super().__init__({w: i + 1 for i, w in enumerate(words)})
        self.words = dict(self)

    def of(self, chunk: str) -> int:
        word, first = chunk.rstrip(".,;:"), WORDS + 1
        c = self.words.get(word)
        if c is None:
            upper = word.isupper()
            c = None if upper else self.words.get(word.lower())
        if c is not None:
            return c
        if not word.isalpha():
            if not any(x.isalpha() for x in word):
                return first + (2 if any(x.isdigit() for x in word) else 3)
            if word[-1] in MARKS:
                return first
        if upper and len(word) > 1:
            return first + 1
        return first + SHAPES + zlib.crc32(word[-2:].lower().encode("utf-8", "surrogatepass")) % (V - first - SHAPES)

    def __missing__(self, chunk: str) -> int:
        c = self.of(chunk)
        if len(self) >= CACHE:
            self.clear()
            self.update(self.words)
        if len(chunk) <= 48:
            self[chunk] = c
        return c

    def windows(self, text: str) -> np.ndarray:
        """Codes (left * V + token) * V + right of all tokens."""
        chunks = text.split()
        c = np.zeros(len(chunks) + 2, np.int64)
        c[1:-1] = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        return (c[:-2] * V + c[1:-1]) * V + c[2:]


class Codes(dict):
    """The code of a chunk: 0 the border, 1..FREQUENT frequent words, else RARE | hash << 7 | class."""

    _latest: tuple[bytes, Codes] | None = None

    @classmethod
    def latest(cls, words: list[str]) -> Codes:
        """One per Python worker for the same words, so that the cache outlives a task."""
        name = blake2b("\n".join(words).encode("utf-8", "surrogatepass")).digest()
        if cls._latest is None or cls._latest[0] != name:
            cls._latest = (name, cls(words))
        return cls._latest[1]

    def __init__(self, words: list[str]):
        super().__init__({w: i + 1 for i, w in enumerate(words)})
        self.words, self.classes = dict(self), Classes(words[:WORDS])
        self.class_of = np.array([0, *(self.classes[w] for w in words)], np.int64)

    def __missing__(self, chunk: str) -> int:
        h = int.from_bytes(blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
        c = RARE | h << 7 | self.classes.of(chunk)
        if len(self) >= CACHE:
            self.clear()
            self.update(self.words)
        if len(chunk) <= 48:
            self[chunk] = c
        return c

    def of(self, text: str) -> np.ndarray:
        """The codes of a text's tokens between two borders."""
        chunks = text.split()
        c = np.zeros(len(chunks) + 2, U)
        c[1:-1] = np.fromiter(map(self.__getitem__, chunks), U, len(chunks))
        return c

    def class_ids(self, codes: np.ndarray) -> np.ndarray:
        rare = codes >= U(RARE)
        return np.where(rare, (codes & U(127)).astype(np.int64), self.class_of[np.where(rare, U(0), codes).astype(np.int64)])


def together(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of many texts in a row, the places of tokens in them and the number of tokens of each."""
    lens = np.array([len(x) - 2 for x in held], np.int64)
    c, inner = np.concatenate(held), np.ones(int(lens.sum()) + 2 * len(lens), bool)
    ends = np.cumsum(lens + 2)
    inner[ends - 1] = inner[ends - lens - 2] = False
    return c, np.flatnonzero(inner), lens


def frequent_words(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The FREQUENT most frequent words and their counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(1):
                count.update(text.as_py().split())
                if len(count) > LOCAL:
                    yield counted()
                    count.clear()
        yield counted()

    found = staged(rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    got = [(r["word"], r["n"]) for r in found.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    return [w for w, _ in got], np.array([0, *(n for _, n in got)], np.int64)


def window_counts(rows: DataFrame, words: list[str]) -> DataFrame:
    """(code, n) of each class window in the corpus and, from V**3 on, of windows within the TOP words.

    There (left * (TOP + 1) + token) * TOP + right with TOP as the token stands for all tokens.
    """
    size = V**3 + TOP * (TOP + 1) * TOP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = Codes.latest(words), np.zeros(size, np.int64)
        for batch in batches:
            held = [codes.of(t.as_py()) for t in batch.column(1)]
            for i in range(0, len(held), 2_000):
                c, at = together(held[i : i + 2_000])[:2]
                k = codes.class_ids(c)
                t = np.minimum(c, U(TOP)).astype(np.int64)
                total += np.bincount((k[at - 1] * V + k[at]) * V + k[at + 1], minlength=size)
                at = at[(t[at - 1] < TOP) & (t[at + 1] < TOP)]
                every = V**3 + (t[at - 1] * (TOP + 1) + TOP) * TOP + t[at + 1]
                top = t[at] < TOP
                here = every[top] + (t[at[top]] - TOP) * TOP
                total += np.bincount(np.concatenate((here, every)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """log P(token | left, right) as an array [left, token, right], by Adam on all counts."""
    rng = np.random.default_rng(seed)
    n = counts.reshape(V, V, V).transpose(0, 2, 1).reshape(V * V, V).astype(np.float32)
    weight = n.sum(axis=1, keepdims=True)
    total = max(float(n.sum()), 1.0)
    params = [rng.normal(0, 0.1, (V, hidden)), rng.normal(0, 0.1, (V, hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, V)), np.log(n.sum(axis=0) + 1)]
    params = [p.astype(np.float32) for p in params]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def forward():
        a, b, bias, out, base = params
        h = np.tanh(a[:, None, :] + b[None, :, :] + bias).reshape(V * V, hidden)
        z = h @ out + base
        z -= z.max(axis=1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    for step in range(1, steps + 1):
        h, logp = forward()
        d = (np.exp(logp) * weight - n) / total
        dh = (d @ params[3].T) * (1 - h * h)
        grid = dh.reshape(V, V, hidden)
        for p, (m, v), g in zip(params, moments, [grid.sum(axis=1), grid.sum(axis=0), dh.sum(axis=0), h.T @ d, d.sum(axis=0)], strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return forward()[1].reshape(V, V, V).transpose(0, 2, 1).copy()


def context_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left * TOP + right within the TOP words, else a hash with the highest bit set."""
    h = mixed(mixed(left) * U(0x9E3779B97F4A7C15) + right) | U(RARE)
    return np.where((left < U(TOP)) & (right < U(TOP)), left * U(TOP) + right, h)


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    return ((np.where(context < U(TOP * TOP), mixed(context + mixed(word)), context) >> U(8)) % U(buckets)).astype(np.int64)


def fixed_log(c: np.ndarray, total: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log P(w | l, r) in 1/SCALE from the counts of window and context and log P0."""
    return np.rint(np.log((c - 1 + MU * np.exp(base)) / (total - 1 + MU)) * SCALE)


#: Tokens of a bucket with the documents of one flush of a task: near are three frequent words each;
#: others have context, word and the classes of both sides, and counts when they go on to their word.
#: (then of many flushes). Or sums of documents; keys and n (tokens) are told once per flush.
PACKED = "bucket int, flush long, docs binary, near binary, context binary, word binary, sides binary, c binary, total binary, sums binary, keys binary, n binary, flushes binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
TYPES = {"docs": np.uint32, "near": np.uint16, "context": U, "word": U, "sides": np.uint8, "c": np.uint32, "total": np.uint32, "sums": np.int64, "keys": np.int64, "n": np.int64, "flushes": np.int64}


def shut(name: str, x: np.ndarray) -> bytes:
    """An array's bytes, first bytes of all values first, compressed."""
    x = np.ascontiguousarray(x.astype(TYPES[name]))
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.reshape(len(x), -1).view(np.uint8).T).tobytes())


def opened(name: str, b: bytes, width: int = 1) -> np.ndarray:
    t = np.dtype(TYPES[name])
    x = np.frombuffer(zs.ZstdDecompressor().decompress(b), np.uint8).reshape(t.itemsize * width, -1)
    x = np.ascontiguousarray(x.T).view(t)
    return x if width > 1 else x[:, 0]


def packed(bucket: np.ndarray, doc: np.ndarray, flush: int, columns: dict) -> list[dict]:
    """One row per bucket; the tokens stay in their order, by document, which compresses well."""
    if not len(bucket):
        return []
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65_536 else bucket, kind="stable")
    bucket, doc = bucket[order], doc[order]
    columns = {k: v[order] for k, v in columns.items()}
    ends = [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    return [{"bucket": int(bucket[s]), "flush": flush, "docs": shut("docs", np.diff(doc[s:e], prepend=0)), **{k: shut(k, v[s:e]) for k, v in columns.items()}} for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def arrow(rows: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "flush": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], types.get(k, pa.binary())) for k in NAMES], names=NAMES)


def by_document(flush: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by flush (numbered) and document, of which a flush has fewer than 2**24."""
    return np.argsort(flush << 24 | doc)


def summed(names: np.ndarray, flush: np.ndarray, doc: np.ndarray, s: np.ndarray, buckets: int) -> list[dict]:
    """Rows of sums of the documents of each flush."""
    order = by_document(flush, doc)
    flush, doc, s = names[flush[order]], doc[order], s[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (flush[1:] != flush[:-1]) | (doc[1:] != doc[:-1]))))[: len(doc)]
    if not len(first):
        return []
    flush, doc, s = flush[first], doc[first], np.add.reduceat(s, first)
    ends = [*np.flatnonzero(flush[1:] != flush[:-1]) + 1, len(flush)]
    return [{"bucket": int(flush[a]) % buckets, "flush": int(flush[a]), "docs": shut("docs", np.diff(doc[a:e], prepend=0)), "sums": shut("sums", s[a:e])} for a, e in zip([0, *ends[:-1]], ends, strict=True)]


class Model:
    """What each task knows: frequent words with their counts, the network's table, counts within TOP."""

    def __init__(self, words: list[str], n: np.ndarray, counts: np.ndarray, buckets: int):
        self.words, self.buckets = words, buckets
        windows = counts[: V**3].reshape(V, V, V)
        self.logp = train(counts[: V**3]).reshape(-1)
        self.log_class = np.log(np.maximum(windows.sum(axis=(0, 2)), 1))
        self.log_n = np.log(np.maximum(n, 1))
        self.class_of = Codes(words).class_of
        self.top = counts[V**3 :]

    def base(self, left: np.ndarray, token: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log P0 without log n(w), from classes."""
        return self.logp[(left * V + token) * V + right].astype(np.float64) - self.log_class[token]

    def within(self, context: np.ndarray, token) -> np.ndarray:
        left, right = context // TOP, context % TOP
        return self.top[(left * (TOP + 1) + token) * TOP + right]


def occurrences(rows: DataFrame, model) -> DataFrame:
    """PACKED rows of all tokens by context, and keys, tokens and sums so far of each flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        codes, held, keys, size = Codes.latest(m.words), [], [], 0

        def flush():
            c, at, lens = together(held)
            key, doc = np.array(keys, np.int64), np.repeat(np.arange(len(held)), lens)
            name = int.from_bytes(blake2b(key.tobytes(), digest_size=8).digest(), "little", signed=True)
            k = codes.class_ids(c)
            left, word, right = c[at - 1], c[at], c[at + 1]
            is_top = (left < U(TOP)) & (word < U(TOP)) & (right < U(TOP))
            is_near = ~is_top & (left < U(RARE)) & (word < U(RARE)) & (right < U(RARE))
            i = np.flatnonzero(is_top)  # done here
            context, token = (left[i] * U(TOP) + right[i]).astype(np.int64), word[i].astype(np.int64)
            done = fixed_log(m.within(context, token), m.within(context, TOP), m.base(k[at[i] - 1], k[at[i]], k[at[i] + 1]) + m.log_n[token])
            sums = np.bincount(doc[i], done, len(held))
            out = [{"bucket": name % m.buckets, "flush": name, "docs": shut("docs", np.minimum(np.arange(len(held)), 1)), "sums": shut("sums", sums), "keys": shut("keys", key), "n": shut("n", lens)}]
            for near, i in ((True, np.flatnonzero(is_near)), (False, np.flatnonzero(~is_top & ~is_near))):
                context = context_of(left[i], right[i])
                if near:
                    columns = {"near": np.stack([left[i], word[i], right[i]], axis=1)}
                else:
                    columns = {"context": context, "word": word[i], "sides": np.stack([k[at[i] - 1], k[at[i] + 1]], axis=1)}
                out += packed(bucket_of(context, word[i], m.buckets), doc[i], name, columns)
            yield arrow(out)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                held.append(codes.of(text.as_py()))
                size += len(held[-1])
                if size > PACK:
                    yield from flush()
                    held, keys, size = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, PACKED)


def unpacked(rows: list[dict], m: Model, columns: list[str]) -> tuple[np.ndarray, dict]:
    """The names of flushes, and the tokens of a bucket: number of the flush, doc, left and right class and the columns."""
    out: dict = {k: [] for k in ["flush", "doc", "lc", "rc", *columns]}
    for r in rows:
        doc = np.cumsum(opened("docs", r["docs"]), dtype=np.uint32).astype(np.int64)  # steps back wrap around
        out["flush"].append(np.full(len(doc), r["flush"], np.int64) if r["flushes"] is None else opened("flushes", r["flushes"]))
        out["doc"].append(doc)
        if r["near"] is not None:
            left, word, right = opened("near", r["near"], 3).T
            sides = m.class_of[left], m.class_of[right]
            out["context"].append(context_of(left.astype(U), right.astype(U)))
            out["word"].append(word.astype(U))
        else:
            sides = opened("sides", r["sides"], 2).T.astype(np.int64)
            for k in columns:
                out[k].append(opened(k, r[k]))
        out["lc"].append(sides[0])
        out["rc"].append(sides[1])
    if any(r["flushes"] is not None for r in rows):
        names, out["flush"] = np.unique(np.concatenate(out["flush"]), return_inverse=True)
    else:
        names, at = np.unique([r["flush"] for r in rows], return_inverse=True)
        out["flush"] = np.repeat(at, [len(x) for x in out["doc"]])
    return names, {k: v if k == "flush" else np.concatenate(v) for k, v in out.items()}


def sizes_of_groups(key: np.ndarray) -> np.ndarray:
    """For each value, how often it occurs."""
    order = np.argsort(key)
    ends = np.append(np.flatnonzero(key[order[1:]] != key[order[:-1]]) + 1, len(key))
    n = np.diff(ends, prepend=0)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(n, n)
    return out


def counted(packs: DataFrame, model, words: bool) -> DataFrame:
    """By context: sums for frequent words, the others go on with their counts; by word: sums for these."""

    def run(table: pa.Table) -> pa.Table:
        m, rows = model.value, table.to_pylist()
        out = [r for r in rows if r["sums"] is not None]
        rows = [r for r in rows if r["sums"] is None]
        if rows and words:
            names, t = unpacked(rows, m, ["word", "c", "total"])
            base = m.base(t["lc"], (t["word"] & U(127)).astype(np.int64), t["rc"]) + np.log(sizes_of_groups(t["word"]))
            out += summed(names, t["flush"], t["doc"], fixed_log(t["c"].astype(np.int64), t["total"].astype(np.int64), base), m.buckets)
        elif rows:
            names, t = unpacked(rows, m, ["context", "word"])
            context, word = t["context"], t["word"]
            total = sizes_of_groups(context)
            within = context < U(TOP * TOP)
            total[within] = m.within(context[within].astype(np.int64), TOP)
            c = sizes_of_groups(mixed(context + U(1)) + mixed(word + U(1)) * U(0x9E3779B97F4A7C15))
            rare = word >= U(RARE)
            i = np.flatnonzero(~rare)
            token = word[i].astype(np.int64)
            s = fixed_log(c[i], total[i], m.base(t["lc"][i], m.class_of[token], t["rc"][i]) + m.log_n[token])
            out += summed(names, t["flush"][i], t["doc"][i], s, m.buckets)
            i = np.flatnonzero(rare)
            i = i[by_document(t["flush"][i], t["doc"][i])]
            sides = np.stack([t["lc"][i], t["rc"][i]], axis=1)
            bucket = (mixed(word[i]) % U(m.buckets)).astype(np.int64)
            out += packed(bucket, t["doc"][i], 0, {"word": word[i], "sides": sides, "c": c[i], "total": total[i], "flushes": names[t["flush"][i]]})
        return pa.Table.from_batches([arrow(out)])

    return packs.groupBy("bucket").applyInArrow(run, PACKED)


def documents(sums: DataFrame) -> DataFrame:
    """(key, n, s, copies) of the documents of each flush; flushes of equal rows are taken together."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [r for r in rows if r["keys"] is not None]
        key, n = opened("keys", told[0]["keys"]), opened("n", told[0]["n"]) * len(told)
        s = np.zeros(len(key), np.int64)
        for r in rows:
            s[np.cumsum(opened("docs", r["docs"]), dtype=np.int64)] += opened("sums", r["sums"])
        return pa.table([key, n, s, np.full(len(key), len(told), np.int64)], names=["key", "n", "s", "copies"])

    return sums.select("flush", "docs", "sums", "keys", "n").groupBy("flush").applyInArrow(run, "key long, n long, s long, copies long")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood, per_token."""
    rows, spark = id_and_text(docs, id_col, text_col), docs.sparkSession
    words, n = frequent_words(rows)
    size = V**3 + TOP * (TOP + 1) * TOP
    counts = np.zeros(size, np.int64)
    for r in bounded_rows(staged(window_counts(rows, words), "windows"), size):
        counts[r["code"]] = r["n"]
    buckets = max(64, 2 * shuffle_width(spark), -(-int(counts[: V**3].sum()) // BUCKET))
    model = spark.sparkContext.broadcast(Model(words, n, counts, buckets))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    found = documents(counted(counted(occurrences(keyed, model), model, False), model, True))
    sums = found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("copies").alias("copies"))
    ids = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))  # rows of one id and text share a key
    scored = ids.join(staged(sums, "sums"), "key").select("doc_id", F.expr("n div copies").alias("n_tokens"), (F.expr("s div copies") / F.lit(float(SCALE))).alias("log_likelihood"))
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).otherwise(0.0))
