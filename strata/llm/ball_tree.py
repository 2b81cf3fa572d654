"""Ball trees over whole-number vectors, searched by bounds on inner products.

A tree's nodes are runs of rows; each keeps a centre, a radius, the range of its labels and its
smallest id. The inner product of a query ``a`` with any row of a node lies within
``a.c - r|a|`` and ``a.c + r|a|``. A search walks the nodes with all queries that still need them:
a query drops a node whose interval misses its score window, whose labels can't fit, or whose
upper bound is strictly beneath the query's current k-th score (or equals it while no id of the
node is smaller). Nothing is approximate: bounds of floating-point centres are widened by more
than their rounding, and scores are whole numbers.
"""

from __future__ import annotations

import io

import numpy as np

LEAF = 256
#: Queries searched at once, which bounds the candidates of a leaf.
QUERIES = 4096
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return {k: found[k] for k in found.files}


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in 16 or 32 bits where they fit."""
    for kind in (np.int16, np.int32):
        if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in node order and the nodes (start, end, right child, centre, radius, labels, smallest id) in preorder."""
    order = np.lexsort((ids, labels))
    nodes: list[list] = []

    def grow(start: int, end: int) -> None:
        at = order[start:end]
        rows, kinds = x[at].astype(np.float64), labels[at]
        centre = rows.mean(axis=0)
        if (rows == rows[0]).all():
            centre, radius = rows[0], 0.0
        else:
            radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        me = len(nodes)
        nodes.append([start, end, 0, centre, radius, kinds.min(), kinds.max(), ids[at].min()])
        if end - start <= LEAF:
            return
        half = (end - start) // 2
        if kinds[0] != kinds[-1]:  # rows of a node with several labels stand in the order of labels
            edges = np.flatnonzero(np.diff(kinds)) + 1
            half = int(edges[np.abs(edges - half).argmin()])
        elif radius:
            wide = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            order[start:end] = at[np.argsort(rows[:, wide], kind="stable")]
        grow(start, start + half)
        nodes[me][2] = len(nodes)
        grow(start + half, end)

    grow(0, len(order))
    start, end, right, centre, radius, low, high, least = map(np.array, zip(*nodes, strict=True))
    return {"ids": ids[order], "labels": labels[order], "x": narrow(x[order]), "start": start, "end": end, "right": right, "centre": centre, "radius": radius, "low": low, "high": high, "least": least}


class Best:
    """The first k rows of each query: by falling score, then by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full(queries, np.iinfo(np.int64).min)  # the k-th so far
        self.id = np.full(queries, NO_ID)
        self.full = np.zeros(queries, bool)
        self.rows = [np.zeros(0, np.int64)] * 3

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.rows, (query, score, id_), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        self.rows = [q[keep], s[keep], i[keep]]
        kth = np.flatnonzero(rank == self.k - 1)
        self.score[q[kth]], self.id[q[kth]], self.full[q[kth]] = s[kth], i[kth], True


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    size = lambda m: max(float(m.max(initial=0)), -float(m.min(initial=0)))
    most = size(a) * size(x) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ x.astype(np.int64).T
    raise OverflowError("an inner product needs more than 64 bits")


def search(tree: dict[str, np.ndarray], best: Best, vectors: np.ndarray, of: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray | None = None, high: np.ndarray | None = None) -> int:
    """Adds a tree's rows to ``best``; returns the number of rows whose scores were computed, over all queries.

    Query j asks with ``vectors[of[j]]`` for rows of its label (``same``) or of any other, with
    scores from ``low[j]`` to ``high[j]``.
    """
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    wide = vectors.astype(np.float64)
    seen = 0
    for at in range(0, len(of), QUERIES):
        stack = [(0, np.arange(at, min(at + QUERIES, len(of))))]
        while stack:
            node, q = stack.pop()
            v = of[q]
            mid, reach = wide[v] @ tree["centre"][node], tree["radius"][node] * norm[v]
            if tree["radius"][node]:
                reach = reach + 1e-9 * (norm[v] * np.sqrt((tree["centre"][node] ** 2).sum()) + reach + 1)
            top, bottom = mid + reach, mid - reach
            fits = (tree["low"][node] <= label[q]) & (label[q] <= tree["high"][node]) if same else ~((tree["low"][node] == label[q]) & (tree["high"][node] == label[q]))
            beneath = best.full[q] & ((top < best.score[q]) | ((top == best.score[q]) & (tree["least"][node] >= best.id[q])))
            q = q[fits & ~beneath & (True if low is None else (top >= low[q]) & (bottom <= high[q]))]
            if not len(q):
                continue
            start, end = int(tree["start"][node]), int(tree["end"][node])
            if end - start > LEAF:
                # the child with the higher mean bound is walked first: thresholds rise sooner
                kids = [node + 1, int(tree["right"][node])]
                sums = [float((wide[of[q]] @ tree["centre"][c]).sum()) for c in kids]
                stack += [(c, q) for _, c in sorted(zip(sums, kids, strict=True))]
                continue
            asked, back = np.unique(of[q], return_inverse=True)
            score = products(vectors[asked], tree["x"][start:end])[back]
            seen += score.size
            ok = score >= np.where(best.full[q], best.score[q], np.iinfo(np.int64).min)[:, None]
            kinds = tree["labels"][start:end][None, :]
            ok &= (kinds == label[q][:, None]) if same else (kinds != label[q][:, None])
            if low is not None:
                ok &= (score >= low[q][:, None]) & (score <= high[q][:, None])
            row, col = np.nonzero(ok)
            if len(row):
                best.add(q[row], score[row, col], tree["ids"][start:end][col])
    return seen
