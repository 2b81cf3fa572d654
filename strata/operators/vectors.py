"""Top-k of many query vectors: exact by blocked products, or through an inverted list of centroids that holds every row.

Scores are inner products over the query's length, so stored vectors are taken as unit vectors and
queries need not be. Rows whose vector is null, empty, of another dimension than most, or not finite
take no part. Rows and queries meet in cells of bounded size; a cell returns the first k
of each of its queries, and a ranking over cells joins them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.staging import staged

#: Rows and queries of one cell.
ROWS, QUERIES = 65_536, 2_048
#: Rows on which centroids are trained at most, and centroids at most.
SAMPLE, CENTROIDS = 20_000, 1_024
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    top = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("v") == (top["d"] if top else -1))


def vectors_of(t: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def cell_best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k rows of each query of a cell, by falling score, then id."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return pa.table([[]] * 3, schema=kind)
        x, q = vectors_of(rows), vectors_of(queries)
        norm = np.sqrt((q * q).sum(axis=1))
        ids = rows.column("id").to_numpy()
        q_ids = queries.column("id").to_numpy()
        out = []
        for at in range(0, len(q), 128):
            score = (q[at : at + 128] @ x.T) / np.where(norm[at : at + 128] > 0, norm[at : at + 128], 1.0)[:, None]
            kth = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)]
            row, col = np.nonzero(score >= kth[:, None])
            s = score[row, col]
            order = np.lexsort((ids[col], -s, row))
            row, col, s = row[order], col[order], s[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
            out.append((q_ids[at + row[keep]], ids[col[keep]], s[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=kind)

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k over all cells."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query against every row, in blocks. A null id is no query and no result."""
    x = staged(usable(rows, id_col, vector_col).filter("id is not null"), "rows")
    q = staged(usable(queries, id_col, vector_col).filter("id is not null"), "queries")
    g, h = max(1, math.ceil(x.count() / ROWS)), max(1, math.ceil(q.count() / QUERIES))
    group = lambda n: F.pmod(F.xxhash64("id", F.hash("v")), F.lit(n)).cast("int")
    a = x.select(group(g).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), "id", "v")
    b = q.select(F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), group(h).alias("h"), "id", "v")
    return merged(a.groupBy("g", "h").cogroup(b.groupBy("g", "h")).applyInArrow(lambda l, r: cell_best(k)(l, r), FOUND), k)  # noqa: E741


def trained_centroids(x: DataFrame, n_rows: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of at most SAMPLE rows, drawn by a hash of the id; about the square root of all rows, CENTROIDS at most."""
    share = min(1.0, SAMPLE / max(n_rows, 1))
    some = x.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(SAMPLE).toArrow()
    v = vectors_of(some)
    k = max(1, min(CENTROIDS, round(math.sqrt(n_rows)), len(v)))
    c = v[np.random.default_rng(seed).permutation(len(v))[:k]]
    for _ in range(rounds):
        near = nearest(v, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector by distance, nearest first."""
    far = (c * c).sum(axis=1)[None, :] - 2 * (v @ c.T)
    n = min(n, len(c))
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


class InvertedLists:
    """Every row under its nearest centroid; the lists are a table in the shared folder."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        x = staged(usable(rows, id_col, vector_col).filter("id is not null"), "rows")
        self.n = x.count()
        self.centroids = trained_centroids(x, self.n) if self.n else np.zeros((1, 1))
        lists = staged(self._assigned(x, 1), "lists")
        # a list of many rows is split into parts of ROWS at most on average; each part is a cell
        sizes = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
        self.sizes = staged(sizes, "sizes")
        self.lists = staged(lists.join(self.sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")).drop("parts"), "lists")

    def _assigned(self, x: DataFrame, n: int) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = nearest(vectors_of(batch), centroids, n)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), batch.column("id").take(at), batch.column("v").take(at)], names=["cell", "id", "v"])

        return x.mapInArrow(run, "cell int, id long, v array<double>")

    def topk(self, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """As ``exact_topk``, looking only into the ``probes`` lists nearest to each query; all lists give the exact result."""
        q = self._assigned(usable(queries, id_col, vector_col).filter("id is not null"), probes)
        q = q.join(self.sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
        q = q.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(queries.count() / QUERIES)))).cast("int"))
        q = staged(q, "probes")
        turns = q.groupBy("cell", "part").agg(F.collect_set("turn").alias("turns"))
        rows = self.lists.join(turns, ["cell", "part"]).select("cell", "part", F.explode("turns").alias("turn"), "id", "v")
        keys = ["cell", "part", "turn"]
        return merged(rows.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda l, r: cell_best(k)(l, r), FOUND), k)  # noqa: E741


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact rows that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def rounded(score: Column) -> Column:
    return F.floor(score * 1e6 + 0.5) / 1e6
