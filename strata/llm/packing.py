"""Packing of token sequences by best-two-fit.

Lengths are integers of at most ``capacity``, so all that decides a packing is the histogram
of lengths, a table of at most ``capacity`` rows at any corpus size. The histogram is packed
on the driver: a bin is filled greedily with the longest documents that fit; then its smallest
document is replaced by two unpacked documents that fill the expanded gap more tightly, as
long as such a pair exists. The resulting pattern of lengths is repeated for as many bins as
the histogram allows, so the number of patterns depends on the capacity, not on the corpus.
Each piece then finds its bin from its rank among the pieces of its length: ranks are row
numbers within (length, salt) plus prefix sums of a counts table of at most
``capacity * SALTS`` rows, so a length that a third of all pieces share is split over tasks.

Defined cases: a null or empty text is the single closing id; only documents longer than the
capacity are cut, into full pieces and a last one that may be shorter; repeated rows are
packed each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, id_and_text, staged
from .word_tokens import WordEncoder

#: Ways in which the pieces of one length are split for ranking.
SALTS = 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (bins, lengths) that use up ``counts`` (by length, index 0 unused)."""
    left = counts.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)
    patterns: list[tuple[int, list[int]]] = []
    while left[1:].any():
        free = left.copy()
        here: list[int] = []
        gap = capacity
        while gap and len(some := np.flatnonzero(free[1 : gap + 1])):
            s = int(some[-1]) + 1
            n = min(gap // s, int(free[s]))
            here += [s] * n
            free[s] -= n
            gap -= s * n
        while gap and len(here) > 1:
            s, room = here[-1], gap + here[-1]
            free[s] += 1
            below = np.maximum.accumulate(np.where(free[: room + 1] > 0, sizes[: room + 1], 0))
            a = np.flatnonzero(free[1 : room + 1]) + 1
            b = below[np.minimum(a, room - a)]
            lone = (b == a) & (free[a] < 2)
            if lone.any():
                b[lone] = below[a[lone] - 1]
            total = np.where(b > 0, a + b, 0)
            k = int(total.argmax()) if len(total) else 0
            if not len(total) or total[k] <= s:
                free[s] -= 1
                break
            here[-1:] = [int(a[k]), int(b[k])]
            free[a[k]] -= 1
            free[b[k]] -= 1
            here.sort(reverse=True)
            gap = room - int(total[k])
        used, need = np.unique(here, return_counts=True)
        times = int((left[used] // need).min())
        left[used] -= need * times
        patterns.append((times, here))
    return patterns


def slots(patterns: list[tuple[int, list[int]]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence id, offset), in the order of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank = np.zeros(capacity + 1, np.int64)
    base = 0
    for times, lengths in patterns:
        offset = 0
        for s in lengths:
            out.setdefault(s, []).append((int(rank[s]), base, offset))
            rank[s] += times
            offset += s
        base += times
    return {s: np.array(x, np.int64) for s, x in out.items()}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each whole text, with the CRC-32 of their ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer_path).encode_bytes
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECE)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a staged table with doc_id, piece, length)."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    for r in bounded_rows(salted.groupBy("length", "salt").count(), capacity * SALTS):
        counts[r["length"], r["salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    place = pieces.sparkSession.sparkContext.broadcast((before, slots(best_two_fit(counts.sum(axis=1), capacity), capacity)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, table = place.value
        for x in frames:
            rank = before[x["length"], x["salt"]] + x["rn"].to_numpy() - 1
            seq, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for s, at in x.groupby("length").indices.items():
                t = table[int(s)]
                k = np.searchsorted(t[:, 0], rank[at], "right") - 1
                seq[at], off[at] = t[k, 1] + rank[at] - t[k, 0], t[k, 2]
            yield x.drop(columns=["salt", "rn"]).assign(sequence_id=seq, offset=off)

    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    return ranked.mapInPandas(run, f"{PIECE}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(token_pieces(id_and_text(docs, id_col, text_col), tokenizer_path, capacity), "pieces"), capacity)
