"""Whitening of embeddings by a one-sided Jacobi SVD of blockwise QR factors.

Entries become integers, so sums and deviations are exact. Each task factors its centred rows
block by block and keeps only the triangle R; triangles meet in groups of a bounded size, round
by round, until one is left. Its singular values are those of all centred rows: plane rotations
on its columns make them orthogonal, the columns' norms are the standard deviations (times a
known factor) and the accumulated rotations the components. Rows are centred as ``n x - S``,
exact integers, before anything is multiplied, so the common offset costs no digits.

No stage holds more than ``BLOCK_BYTES`` of rows and a few d x d triangles, d being the dimension;
the driver sees one triangle and d sums. The rows are read four times and never shuffled.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part.
The dimension is the one that most rows have (the larger of equally frequent ones); rows of
another are left out. Repeated rows count and are returned each; a null id stays null; ties of
eigenvalues are ordered by the rotations' columns. A component without variance has ``whitened``
0 and ``explained`` 0, and ``identity_error`` is then 1. No rows give an empty result. Entries
beyond the range of the integers raise an error, and so does a deviation beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Bytes of rows that a task factors at once.
BLOCK_BYTES = 8 << 20
#: Bytes of triangles that meet in one group.
GROUP_BYTES = 64 << 20
SWEEPS = 60
#: Columns count as orthogonal when their cosine is below this.
EPS = 1e-15


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the whole numbers x of each vector that takes part."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform("v", lambda c: (F.floor(c * 1024) + 100000).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of the rows of dimension ``d``."""
    ids, x = batch.column("vec_id"), batch.column("x")
    fits = np.diff(x.offsets.to_numpy()) == d
    if not fits.all():
        ids, x = ids.filter(pa.array(fits)), x.filter(pa.array(fits))
    return ids, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors of the ruling dimension and their exact sums by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d in np.unique(np.diff(batch.column("x").offsets.to_numpy())):
                _, m = matrix(batch, int(d))
                n, s = found.get(int(d), (0, 0))
                found[int(d)] = (n + len(m), s + m.sum(axis=0))
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d, d, np.int32), "k": np.arange(d, dtype=np.int32), "n": np.full(d, n), "s": s})

    by = staged(x.mapInArrow(run, "d int, k int, n long, s long").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    top = by.filter("k = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if top is None:
        return 0, np.zeros(0, np.int64)
    return top["n"], np.array([r["s"] for r in by.filter(F.col("d") == top["d"]).orderBy("k").collect()], np.int64)


def centred(m: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """The exact integers n x - S."""
    if len(m) and (float(np.abs(m).max()) + float(np.abs(s).max()) / n) * n > 9e18:
        raise OverflowError("n x - S needs more than 64 bits")
    return m * n - s


def reduced(stack: list[np.ndarray]) -> np.ndarray:
    r = np.linalg.qr(np.vstack(stack), mode="r")
    return r if r.shape[0] == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))])


def triangle(x: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d = len(s)
    block = max(d, BLOCK_BYTES // (8 * d))
    fan_in = max(2, min(32, GROUP_BYTES // (8 * d * d)))
    kind = "part long, r binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, count = None, [], 0
        for batch in batches:
            _, m = matrix(batch, d)
            for at in range(0, len(m), block):
                held.append(centred(m[at : at + block], n, s).astype(np.float64))
                count += len(held[-1])
                if count >= block:
                    r, held, count = reduced([*([] if r is None else [r]), *held]), [], 0
        if held:
            r = reduced([*([] if r is None else [r]), *held])
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "r": [r.tobytes()]})

    def meet(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("part").to_numpy())
        raw = t.column("r").to_pylist()
        r = reduced([np.frombuffer(raw[k]).reshape(d, d) for k in order])
        return pa.table({"part": [int(t.column("part").to_numpy().min()) // fan_in], "r": [r.tobytes()]})

    rs = staged(x.mapInArrow(local, kind), "triangles")
    top = rs.agg(F.max("part")).first()[0]
    while top:
        rs = rs.groupBy((F.col("part") / fan_in).cast("long").alias("g")).applyInArrow(meet, kind)
        top //= fan_in
    return np.frombuffer(bytes(rs.first()["r"])).reshape(d, d)


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A tournament: every pair of columns once, in rounds of pairs without a common column."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        p, q = np.array(ring[: len(ring) // 2]), np.array(ring[: len(ring) // 2 - 1 : -1])
        real = (p < d) & (q < d)
        yield p[real], q[real]
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of ``r``, by plane rotations."""
    size = np.abs(r).max() if r.size else 0.0
    a = r / size if size else r.copy()
    v = np.eye(a.shape[1])
    pairs = list(rounds(a.shape[1]))
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in pairs:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            off = np.abs(xy) > EPS * scale
            if not off.any():
                continue
            worst = max(worst, float((np.abs(xy[off]) / scale[off]).max()))
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=off)
            t = np.where(off, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst < 1e-14:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    v = v[:, order] / np.sqrt((v[:, order] ** 2).sum(axis=0))
    biggest = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return norms[order] * size, v * np.where(biggest < 0, -1.0, 1.0)


def whitener(n: int, s: np.ndarray, sigma: np.ndarray, v: np.ndarray, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of n x - S to their first ``k`` whitened coordinates."""
    deviation = sigma[:k] / np.sqrt(n)  # of n x
    flat = sigma[:k] <= sigma[0] * len(s) * np.finfo(float).eps
    weight = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, deviation))
    return lambda y: (y.astype(np.float64) @ v[:, :k]) * weight


def identity_error(x: DataFrame, n: int, s: np.ndarray, white: Callable[[np.ndarray], np.ndarray], k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows.

    Moments are centred in each batch and merged pairwise, so no product is taken before centring.
    """
    d = len(s)

    def merge(a, b):
        if a is None:
            return b
        (na, ma, ca), (nb, mb, cb) = a, b
        gap = mb - ma
        return na + nb, ma + gap * (nb / (na + nb)), ca + cb + np.outer(gap, gap) * (na * nb / (na + nb))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for batch in batches:
            _, m = matrix(batch, d)
            if len(m):
                w = white(centred(m, n, s))
                mean = w.mean(axis=0)
                all_ = merge(all_, (len(w), mean, (w - mean).T @ (w - mean)))
        if all_ is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [all_[0]], "m": [all_[1].tobytes()], "c": [all_[2].tobytes()]})

    def meet(t: pa.Table) -> pa.Table:
        all_ = None
        for r in sorted(t.to_pylist(), key=lambda r: r["part"]):
            all_ = merge(all_, (r["n"], np.frombuffer(r["m"]), np.frombuffer(r["c"]).reshape(k, k)))
        return pa.table({"part": [min(t.column("part").to_pylist()) // 256], "n": [all_[0]], "m": [all_[1].tobytes()], "c": [all_[2].tobytes()]})

    kind = "part long, n long, m binary, c binary"
    moments = staged(x.mapInArrow(run, kind), "moments")
    top = moments.agg(F.max("part")).first()[0]
    while top:
        moments = moments.groupBy((F.col("part") / 256).cast("long").alias("g")).applyInArrow(meet, kind)
        top //= 256
    one = moments.first()
    return float(np.abs(np.frombuffer(bytes(one["c"])).reshape(k, k) / one["n"] - np.eye(k)).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = clean_vectors(rows, id_col, vector_col)
    n, s = sums(x)
    if not n:
        return rows.sparkSession.createDataFrame([], OUT)
    d, k = len(s), min(components, len(s))
    sigma, v = jacobi(triangle(x, n, s))
    white = whitener(n, s, sigma, v, k)
    total = float((sigma**2).sum())
    explained = sigma[:k] ** 2 / total if total else np.zeros(k)
    error = identity_error(x, n, s, white, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = matrix(batch, d)
            if not len(m):
                continue
            y = centred(m, n, s)
            if (y.astype(np.float64) ** 2).sum(axis=1).max() > 9.2e18:
                raise OverflowError("a deviation needs more than 64 bits")
            each = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(each), n)), pa.array((y * y).sum(axis=1)[each]), pa.array(white(y).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, OUT)
