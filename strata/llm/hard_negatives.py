"""Hard negatives by branch-and-bound over per-partition ball trees.

Each task builds ball trees over its own rows, ``TREE_BYTES`` of vectors each, and writes them to
the shared folder as rows of a table; anchors are written in blocks. Blocks and trees meet in a grid
of cells: each tree goes to every group of blocks and each block to every group of trees,
so a cell holds a bounded number of both and any number of anchors and rows is covered without a
broadcast. A cell's queries carry their k-th best from tree to tree, which prunes the later ones,
and only the first k rows of each query leave it; a ranking per query over cells, cut by Spark
to k rows on the map side, joins them. Two searches run: first the positives, then, with each
positive's score window as the query's interval, the negatives.

Defined cases: rows with a null label, a null or empty vector, null or non-finite entries take no
part. The dimension is the one of most rows (the larger of equally frequent ones), others take no
part. A null id is no anchor and comes last among ties, as a negative it stays null. Repeated rows
take part each: an anchor's copies are other rows, so they can be its positives, and each copy of an anchor is an anchor. Labels change only where an id is divisible by 7.
No anchors or no rows give an empty result. Further columns are ignored. Entries or products beyond 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ball_tree as B
from .common import staged

#: Bytes of vectors (64-bit) of one tree and of one block of anchors.
TREE_BYTES = 16 << 20
BLOCK_BYTES = 2 << 20
#: Trees and blocks that meet in one cell.
TREES, BLOCKS = 4, 8
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Rows of one task, numbered so that groups of consecutive trees and blocks are even.
PART = 1 << 20


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, shift: Column | None) -> DataFrame:
    """vec_id, label after the shift, whole numbers x; of the ruling dimension."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long"))
    label = F.col(label_col).cast("long")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), (label if shift is None else shift).alias("label"), v.alias("v")).filter(F.col("label").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    out = kept.select("vec_id", "label", x.alias("x"))
    top = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.filter(F.size("x") == (top["d"] if top else -1))


def gathered(x: DataFrame, most: int, tree: bool) -> DataFrame:
    """Rows packed ``most`` at a time (name, rows, payload): as ball trees, or plain blocks. The name tells task and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
            raw = B.packed(B.build(ids, labels, vectors) if tree else {"ids": ids, "labels": labels, "x": B.narrow(vectors)})
            return pa.RecordBatch.from_pydict({"name": [part * PART + number], "n": [len(ids)], "payload": [raw]})

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch.column("vec_id").fill_null(B.NO_ID).to_numpy()
            labels = batch.column("label").to_numpy()
            for at in range(0, len(ids), most):
                cut = slice(at, at + most)
                if held and count + len(ids[cut]) > most:
                    yield out()
                    held, count, number = [], 0, number + 1
                held.append((ids[cut], labels[cut], vectors[cut]))
                count += len(ids[cut])
        if held:
            yield out()

    return staged(x.mapInArrow(run, "name long, n long, payload binary"), "ball_trees" if tree else "anchor_blocks")


def grouped_by(name: str, size: int, total: int) -> tuple[Column, int]:
    """Group number of a tree or block, and the number of groups: consecutive tasks go round."""
    groups = max(1, math.ceil(total / size))
    return F.pmod((F.col(name) / PART).cast("long") + F.pmod(F.col(name), F.lit(PART)), F.lit(groups)).cast("int"), groups


def searched(trees: DataFrame, blocks: DataFrame, k: int, windows: bool) -> DataFrame:
    """The first k rows of each query over all trees: name and window (the query), at (its anchor), rank, score, id.

    With ``windows`` the blocks hold score windows (of, low, high) and rows of other labels are
    asked for; else rows of the same label, the anchor itself among them.
    """
    tg, n_tree_groups = grouped_by("name", TREES, trees.count())
    bg, n_block_groups = grouped_by("name", BLOCKS, blocks.count())
    t = trees.select(F.explode(F.sequence(F.lit(0), F.lit(n_block_groups - 1))).alias("b"), tg.alias("t"), "name", "payload")
    b = blocks.select(bg.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_tree_groups - 1))).alias("t"), "name", "payload")
    cell = (F.col("b").cast("long") * n_tree_groups + F.col("t")).alias("cell")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        found = [(name, B.unpacked(raw)) for name, raw in sorted(zip(right.column("name").to_pylist(), right.column("payload").to_pylist(), strict=True))]
        if found and left.num_rows:
            vectors, labels = np.concatenate([p["x"] for _, p in found]), np.concatenate([p["labels"] for _, p in found])
            before = np.cumsum([0, *(len(p["x"]) for _, p in found)])
            name, at = np.repeat([n for n, _ in found], np.diff(before)), np.arange(len(vectors)) - np.repeat(before[:-1], np.diff(before))
            if windows:
                of = np.concatenate([p["of"] + s for (_, p), s in zip(found, before, strict=False)])
                window = np.concatenate([np.arange(len(p["of"])) for _, p in found])
                low, high = (np.concatenate([p[c] for _, p in found]) for c in ("low", "high"))
            else:
                of, window, low, high = np.arange(len(vectors)), np.arange(len(vectors)) - np.repeat(before[:-1], np.diff(before)), None, None
            best = B.Best(len(of), k)
            for raw in left.sort_by("name").column("payload"):
                tree = B.unpacked(raw.as_py())
                B.search(tree, best, vectors, of, labels[of], not windows, low, high)
            q, s, i = best.rows
            rows = [name[of[q]], at[of[q]], window[q], s, i]
        return pa.table(rows or [[]] * 5, schema=pa.schema([(c, pa.int64()) for c in ("name", "at", "window", "score", "id")]))

    cells = t.select(cell, "name", "payload").groupBy("cell").cogroup(b.select(cell, "name", "payload").groupBy("cell")).applyInArrow(run, "name long, at long, window long, score long, id long")
    w = Window.partitionBy("name", "window").orderBy(F.desc("score"), "id")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_every: int = 100, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """One row per anchor, positive and hard negative (``low`` and ``high`` in per cent of the positive's score)."""
    spark = rows.sparkSession
    label = F.col(label_col).cast("long")
    shift = F.when(F.col(id_col).cast("long") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    x = whole_vectors(rows, id_col, vector_col, label_col, scale, shift)
    d = x.select(F.size("x")).first()
    if d is None:
        return spark.createDataFrame([], OUT)
    trees = gathered(x, max(B.LEAF, TREE_BYTES // (8 * d[0])), True)
    blocks = gathered(x.filter(F.col("vec_id") % anchors_every == 0), max(1, BLOCK_BYTES // (8 * d[0])), False)
    # one more than asked for: the anchor itself may be among them
    found = searched(trees, blocks, positives + 1, False).select("name", "at", "rank", "score", "id")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([[]] * 3, schema=pa.schema([("name", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]))
        block = B.unpacked(left.column("payload")[0].as_py())
        p = right.sort_by([("at", "ascending"), ("rank", "ascending")])
        at, score, id_ = (p.column(c).to_numpy() for c in ("at", "score", "id"))
        x = block["x"].astype(object)
        mine = (id_ == block["ids"][at]) & (score == np.array([(v * v).sum() for v in x])[at])
        first = np.unique(np.where(mine, at, -1), return_index=True)[1]
        mine = mine & np.isin(np.arange(len(at)), first)  # of equal copies one is the anchor
        at, score, id_ = at[~mine], score[~mine], id_[~mine]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)]
        keep = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) < positives
        at, score, id_ = at[keep], score[keep], id_[keep]
        block |= {"of": at, "positive": id_, "positive_score": score, "low": -(-low * score // 100), "high": high * score // 100}
        return pa.table({"name": left.column("name").to_pylist(), "n": [len(score)], "payload": [B.packed(block)]})

    asked = staged(blocks.groupBy("name").cogroup(found.groupBy("name")).applyInArrow(ask, "name long, n long, payload binary"), "score_windows")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("payload"), strict=True):
                p = B.unpacked(raw.as_py())
                n = len(p["of"])
                yield pa.RecordBatch.from_pydict({"name": np.full(n, name), "window": np.arange(n), "anchor_id": p["ids"][p["of"]], "positive_id": p["positive"], "positive_score": p["positive_score"]})

    asks = asked.select("name", "payload").mapInArrow(named, "name long, window long, anchor_id long, positive_id long, positive_score long")
    known = lambda c: F.when(F.col(c) != B.NO_ID, F.col(c))
    out = searched(trees, asked, negatives, True).join(asks, ["name", "window"])
    return out.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
