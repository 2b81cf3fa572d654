"""Packing with a controlled mixture: deficit round-robin over one token queue per source.

Each source is a queue of its documents' tokens. Every window of ``capacity`` tokens credits
each queue with its share of the window; a queue gives the whole tokens that it is due and carries
the rest of its credit, its deficit, into the next window. Served one token at a time, the queue
that gives next is the one whose token was due first: token i of a queue of weight w is due at
time (i + 1/2) / w, and a queue that runs dry leaves its share to the others. That order is total,
so what a queue has given before window ``v`` is a function of ``v`` and the queues' sizes alone
(``Mixture.given``): deficits carry over windows and over partitions without any state passing
between tasks, and each document finds its own windows from its place in its queue. After any
window a queue's deficit is below ``1/2 + queues / 2`` tokens while no queue is dry.

Plan: one pass tokenises, counts each document's place among the tokens of its queue within its
task, and writes the ids; the counts per (queue, task), a table of queues x tasks, get their
running totals by blocks of tasks; a second pass reads the ids and cuts the pieces. Texts are
never shuffled, ids only if that small table is too large for Spark to broadcast.

Without targets a source's share is its share of all tokens, so every window has the corpus's
mixture and no queue runs dry before the others. All windows are full; what is left at the end is
one run, cut into sequences whose lengths are falling powers of two, which need no padding.

Defined cases: a null or empty text is the single closing id; a null source is a queue of its own;
repeated rows are packed each; a source without a target gets weight 0: its tokens are dealt after
all others, by their own proportions, never dropped; an empty table gives an empty result; further
columns are ignored. More than ``QUEUES`` sources are an error: the caller maps sources to queues.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, staged
from .word_tokens import WordEncoder

#: Queues at most; windows hold a run of each.
QUEUES = 4096
#: Tasks whose totals are added up in one group.
BLOCK = 1024
#: Table entries (windows x queues) computed at once.
ENTRIES = 1 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


class Mixture:
    """The order in which queues of ``sizes`` tokens and ``weights`` are served."""

    def __init__(self, sizes: list[int], weights: list[int], capacity: int):
        self.capacity, self.total = capacity, sum(sizes)
        # two phases: queues with a weight, then those without, by their sizes
        first = [w > 0 for w in weights]
        self.size = np.array(sizes, np.int64)
        self.rate = np.array([w if f else n for n, w, f in zip(sizes, weights, first, strict=True)], float)
        ends = [n / r for n, r, f in zip(sizes, self.rate, first, strict=True) if f and n]
        self.shift = np.where(first, 0.0, max(ends, default=0.0) * (1 + 1e-9) + 1.0 if ends else 0.0)
        stops = np.where(self.size > 0, self.shift + self.size / np.maximum(self.rate, 1), self.shift)
        self.times = np.unique(np.concatenate([[0.0], self.shift, stops]))
        self.ranks = np.array([np.clip((t - self.shift) * self.rate, 0, self.size).sum() for t in self.times])

    def due(self, queue: np.ndarray, i: np.ndarray) -> np.ndarray:
        """When token i is due, inf beyond the queue's end."""
        return np.where((i >= 0) & (i < self.size[queue]), self.shift[queue] + (i + 0.5) / np.maximum(self.rate[queue], 1e-300), np.where(i < 0, -np.inf, np.inf))

    def given(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each window: a table of windows x queues."""
        out = np.zeros((len(windows), len(self.size)), np.int64)
        step = max(1, ENTRIES // max(1, len(self.size)))
        for at in range(0, len(windows), step):
            out[at : at + step] = self._given(windows[at : at + step])
        return out

    def _given(self, windows: np.ndarray) -> np.ndarray:
        goal = np.minimum(windows * self.capacity, self.total)
        at = np.interp(goal, self.ranks, self.times)[:, None]
        b = np.clip(np.ceil((at - self.shift) * self.rate - 0.5), 0, self.size).astype(np.int64)
        every = np.arange(len(self.size))[None, :]
        rows = np.arange(len(goal))
        while len(rows):
            x = b[rows]
            after, before = self.due(every, x), self.due(every, x - 1)
            low = after.argmin(axis=1)  # of equal times the first queue
            high = x.shape[1] - 1 - before[:, ::-1].argmax(axis=1)  # of equal times the last
            k = np.arange(len(rows))
            short = goal[rows] - x.sum(axis=1)
            swap = (short == 0) & ((after[k, low] < before[k, high]) | ((after[k, low] == before[k, high]) & (low < high)))
            add, cut = (short > 0) | swap, (short < 0) | swap
            b[rows[add], low[add]] += 1
            b[rows[cut], high[cut]] -= 1
            rows = rows[add | cut]
        return b

    def window_of(self, queue: np.ndarray, i: np.ndarray) -> np.ndarray:
        """About the window of token i; the right one is at most ``slack`` away."""
        return (np.interp(self.due(queue, i), self.times, self.ranks) // self.capacity).astype(np.int64)

    @property
    def slack(self) -> int:
        return len(self.size) // self.capacity + 2


def tail_sequences(rest: int) -> list[int]:
    """Lengths of the last sequences: falling powers of two that add up to ``rest``."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def queue_name(source: str | Column) -> Column:
    s = (F.col(source) if isinstance(source, str) else source).cast("string")
    return F.coalesce(F.concat(F.lit("="), s), F.lit(""))


def token_queues(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of each document (doc_id, text, queue) and its place among its queue's tokens of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer_path).encode_bytes
        end = np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            places, lengths, ids = [], [], []
            for text, queue in zip(batch.column("text"), batch.column("queue").to_pylist(), strict=True):
                raw = np.frombuffer(encode(text.as_py()) + end, "<u4")
                places.append(at.get(queue, 0))
                at[queue] = places[-1] + len(raw)
                lengths.append(len(raw))
                ids.append(raw.astype("<u2").tobytes() if int(raw.max()) < 1 << 16 else b"\0" + raw.tobytes())  # an odd length tells the wide form
            if lengths:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(ids), pa.int64()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "at", "doc_tokens", "ids"])

    return docs.select("doc_id", "text", "queue").mapInArrow(run, "doc_id long, queue string, part long, at long, doc_tokens long, ids binary")


def wide(ids: bytes) -> memoryview:
    """Little-endian 32-bit ids."""
    return memoryview(ids)[1:] if len(ids) % 2 else memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def queue_starts(tokens: DataFrame) -> DataFrame:
    """First place of each (queue, part) in its queue, by running totals within and over blocks of tasks."""
    each = staged(tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")).withColumn("block", (F.col("part") / BLOCK).cast("long")), "queue_parts")
    blocks = each.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    before = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outer = blocks.select("queue", "block", F.coalesce(before(Window.partitionBy("queue").orderBy("block")), F.lit(0)).alias("outer"))
    inner = each.select("queue", "block", "part", "n", F.coalesce(before(Window.partitionBy("queue", "block").orderBy("part")), F.lit(0)).alias("inner"))
    return staged(inner.join(outer, ["queue", "block"]).select("queue", "part", "n", (F.col("inner") + F.col("outer")).alias("base")), "queue_starts")


def cut(mix: Mixture, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents at places ``first`` of their queues: (document, start, length, sequence, offset)."""
    whole = mix.total // mix.capacity
    last = first + length - 1
    low = np.maximum(mix.window_of(queue, first) - mix.slack, 0)
    high = np.minimum(mix.window_of(queue, last) + mix.slack, whole)
    windows = np.unique(np.concatenate([np.arange(a, b + 2) for a, b in np.unique(np.stack([low, high], 1), axis=0)]))
    given = mix.given(windows)
    left = np.cumsum(given, axis=1) - given  # of all queues before this one
    n = high - low + 1
    doc = np.repeat(np.arange(len(queue)), n)
    w = np.searchsorted(windows, np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
    q = queue[doc]
    a, b = np.maximum(given[w, q], first[doc]), np.minimum(given[w + 1, q], last[doc] + 1)
    some = b > a
    doc, w, q, a, b = doc[some], w[some], q[some], a[some], b[some]
    offset = left[w + 1, q] - left[w, q] + a - given[w, q]
    sequence, start = windows[w], a - first[doc]
    size = b - a
    rest = sequence == whole
    if rest.any():  # the last run is cut once more
        edges = np.cumsum([0, *tail_sequences(mix.total - whole * mix.capacity)])
        more = []
        for d, s, o, k in zip(doc[rest], start[rest], offset[rest], size[rest], strict=True):
            for j in range(len(edges) - 1):
                x, y = max(o, edges[j]), min(o + k, edges[j + 1])
                if y > x:
                    more.append((d, s + x - o, y - x, whole + j, x - edges[j]))
        keep = ~rest
        doc, start, size, sequence, offset = (np.concatenate([x[keep], y]) for x, y in zip((doc, start, size, sequence, offset), np.array(more, np.int64).T, strict=True))
        order = np.lexsort((start, doc))
        doc, start, size, sequence, offset = doc[order], start[order], size[order], sequence[order], offset[order]
    return doc, start, size, sequence, offset


def mixture_packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, targets: dict[str | None, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``targets``: whole weights by source, relative to each other; None for the corpus's own mixture.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), queue_name(source_col).alias("queue"))
    tokens = staged(token_queues(rows, tokenizer_path, end_id), "token_queues")
    starts = queue_starts(tokens)
    found = sorted((r["queue"], r["n"]) for r in bounded_rows(starts.groupBy("queue").agg(F.sum("n").alias("n")), QUEUES))
    if not found:
        return spark.createDataFrame([], PIECE)
    names, sizes = [q for q, _ in found], [n for _, n in found]
    wanted = None if targets is None else {"" if s is None else f"={s}": w for s, w in targets.items()}
    mix = Mixture(sizes, sizes if wanted is None else [wanted.get(q, 0) for q in names], capacity)
    number = {q: k for k, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([number[q] for q in batch.column("queue").to_pylist()])
            first = (batch.column("base").to_numpy() + batch.column("at").to_numpy()).astype(np.int64)
            total = batch.column("doc_tokens").to_numpy()
            doc, start, size, sequence, offset = cut(mix, queue, first, total)
            crc, held, ids = np.zeros(len(doc), np.int64), -1, None
            raw = batch.column("ids")
            for k, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)):
                if d != held:
                    held, ids = d, wide(raw[d].as_py())
                crc[k] = zlib.crc32(ids[4 * s : 4 * (s + n)])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(start), pa.array(size), pa.array(crc), batch.column("doc_tokens").take(at), pa.array(sequence), pa.array(offset), batch.column("queue").take(at)], names=[f.split()[0] for f in PIECE.split(", ")])

    return tokens.join(starts.select("queue", "part", "base"), ["queue", "part"]).select("doc_id", "queue", "base", "at", "doc_tokens", "ids").mapInArrow(run, PIECE)


def window_mixture(pieces: DataFrame) -> DataFrame:
    """Tokens of each queue in each sequence (sequence_id, queue, tokens), to hold against the targets."""
    return pieces.groupBy("sequence_id", "queue").agg(F.sum("length").alias("tokens"))
