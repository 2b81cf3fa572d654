"""Exact Jaccard self-join of shingle sets with adaptive multi-match prefixes.

Tokens (hashed shingles) have one global order: those found frequent by a counting pass come
last, the rest in hash order. Two sets of Jaccard similarity t or more share at least l of the
first ``n - ceil(t n) + l`` tokens of each, for every l. Each document chooses its own l of at
most LEVELS: a longer prefix costs more index entries, but l shared prefix tokens are then asked for,
which drops candidates; the estimate uses the counted frequencies, so only documents full of
common passages lengthen their prefix.

Data flow. (1) One pass gives each document's set size, a 64-bit name of its set with 64 bits to
check it (a clash names all sets anew) and the shingles that are frequent in its task; documents
of equal sets are one node from there on. (2) A second pass sends prefix postings, packed per token
bucket (their number follows from the measured sizes); a token's entries meet and only those with
company stay, each node once. (3) Pivot rounds: in every token's list,
documents outside the list's largest component are compared with a few of its members, so a
group of g near copies joins up with O(g) comparisons; where lists are long, further rounds compare
with more members, so that a copy that few members link with needs not meet all of them. (4) The exhaustive round lists all pairs
of documents that are still in different components and share l prefix tokens, with length and
positional filters and a bitmap filter, and verifies each; so no link between components is
lost. Pairs inside a component are never needed. Verification compares whole sets.

Bitmap filter: each set has BITS bits, a bit being the parity of the tokens that fall on it. The
bits that differ between two sets are at most the tokens that only one of them has, and a link
leaves at most a seventh of both sizes; so a pair with more differing bits is no link. Lists carry
BITS bits; pairs found are looked up again by bitmaps of about two bits a token, folded to the same
width, which tell large sets apart too. Of a pivot round's pairs only the NEAREST of each document
are verified; the exhaustive round verifies all.

The order of frequent tokens is only an estimate and affects cost, not results. Lists of more
than ``BLOCK`` expected entries are dealt into blocks that meet pairwise.

Defined cases: null and empty texts and texts without words have no shingles, link with
nothing and are their own component; fewer than five words are one shingle; every row is returned,
repeated rows too; rows of one id and different texts are nodes of their own; null ids count as
larger than all others, so a component's id is null only if all its ids are; an empty
table gives an empty result; further columns are ignored. The filter keeps a component's row of the
smallest id, once, and all texts without words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, discard, id_and_text, picked, row_key, shared_dir, shuffle_width, staged, without
from .components import components
from .shingles import mixed, shingle_sets

#: Frequent shingles that get a place at the end of the order: the bound of what is broadcast.
FREQUENT = 65_536
#: Documents of one task that must share a shingle before the task reports it.
LOCAL_MIN = 8
LEVELS = 24
#: Cost of verifying a candidate against that of reading a posting; the share of prefix tokens
#: that is taken to have company beyond what was counted.
VERIFY, COMPANY = 64, 0.05
BLOCK = 8_192
MEMBERS, BEST, NEAREST, PIVOT_ROUNDS = 6, 6, 2, 3
#: The same for the rounds after these, which take only lists of more than LONG sets and end when one finds no link.
WIDER, LONG = [(48, 48, 12), (96, 96, 24)], 96
#: Places for the lists of one home, and rows of a home that a task holds at once.
PARTS, HELD = 2, 200_000
#: Pairs that a task holds at once, and those that leave it in one batch.
TOLD, SENT = 400_000, 50_000
#: Postings of a bucket on average; names of sets that a task keeps in mind.
BUCKET, SEEN = 300_000, 100_000
#: Copies of a group's row for a join with its sets; sets with more than one in MANY rows are hot.
SALTS, MANY = 16, 1_000
#: Bits of a list's bitmaps; most bits of a set's own one.
BITS, WIDE = 512, 65_536
BIT_COLS = [f"b{i}" for i in range(BITS // 64)]
U = np.uint64


def long_of(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def set_key(h: np.ndarray, salt: int) -> tuple[int, int]:
    """A set's name in this run, and 64 further bits that tell whether names clash."""
    d = blake2b(h.tobytes(), digest_size=16, key=bytes([salt])).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Seen(set):
    """Names of sets that a task has met; only saves work, so it may forget."""

    def new(self, name: int) -> bool:
        if name in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(name)
        return True


def summarise(docs: DataFrame, k: int, salt: int) -> DataFrame:
    """kind 0: doc_id, row key, size, name and check of each row's set; kind 1: a frequent token and its local count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "at", "n", "node", "check"]
        seen, held, size = Seen(), [], 0

        def frequent():
            h = np.concatenate(held)
            slot = (h & U(2**20 - 1)).astype(np.int32)
            u, c = np.unique(h[np.bincount(slot, minlength=2**20)[slot] >= LOCAL_MIN], return_counts=True)
            u, c = u[c >= LOCAL_MIN], c[c >= LOCAL_MIN]
            z = pa.array(np.zeros(len(u), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), long_of(u), z, pa.array(c), z, z], names=names)

        for batch in batches:
            n, node, check = [], [], []
            for h in shingle_sets(batch.column(2), k):
                name, more = set_key(h, salt) if len(h) else (0, 0)
                n.append(len(h))
                node.append(name)
                check.append(more)
                if len(h) and seen.new(name):
                    held.append(h)
                    size += len(h)
                if size > 1_000_000:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, node, check))], names=names)
        if held:
            yield frequent()

    return docs.mapInArrow(run, "kind int, key long, at long, n long, node long, check long")


def base_level(n: int) -> int:
    """The l of least estimated cost for a set of n tokens of unknown frequency; grows with n."""
    return max(min(int(math.sqrt(VERIFY * COMPANY / 4 * n)), LEVELS, -(-3 * n // 4)), 1)


def chosen_level(df: np.ndarray, n: int) -> int:
    """The l of least estimated cost, ``base_level`` at least; df: counted frequencies in the global order."""
    least = -(-3 * n // 4)
    low = base_level(n)
    total, met = np.cumsum(df), np.cumsum(df - 1 + COMPANY)
    p = n - least + np.arange(low, min(LEVELS, least) + 1) - 1
    return low + int(np.argmin(total[p] + VERIFY * met[p] / np.arange(low, low + len(p))))


def prefix_postings(docs: DataFrame, k: int, salt: int, tokens: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Packed postings (token, node, set size << 32 | position << 5 | l) per bucket of tokens."""
    table = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = table.value
        near = np.zeros(2**22, np.bool_)  # few other shingles share a frequent one's leading bits
        near[tokens >> U(42)] = True
        seen, held, size = Seen(), [], 0

        def packed():
            h, node, at = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (h >> U(20)) % U(buckets)
            order = np.argsort(b, kind="stable")
            h, node, at, b = h[order], node[order], at[order], b[order]
            ends = np.flatnonzero(np.concatenate((b[1:] != b[:-1], [True]))) + 1
            starts = [0, *ends[:-1]]
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(b[starts].astype(np.int32)), cut(h), cut(node), cut(at)], names=["bucket", "tokens", "nodes", "places"])

        for batch in batches:
            for h in shingle_sets(batch.column(2), k):
                n = len(h)
                if not n or not seen.new(name := set_key(h, salt)[0]):
                    continue
                level = base_level(n)
                count = np.zeros(n, np.int64)
                if len(some := np.flatnonzero(near[h >> U(42)])):
                    i = np.minimum(np.searchsorted(tokens, h[some]), len(tokens) - 1)
                    count[some] = np.where(tokens[i] == h[some], counts[i], 0)
                    if count.any():
                        order = np.lexsort((h, count))
                        h, count = h[order], count[order]
                        level = chosen_level(np.maximum(count, 1), n)
                p = min(n, max(n - -(-3 * n // 4) + level, n - -(-6 * n // 7) + LEVELS))
                at = U(n) << U(32) | np.arange(p, dtype=U) << U(5) | U(level)
                h, count = h[:p], count[:p]
                if (count > BLOCK).any():
                    more = []
                    for j in np.flatnonzero(count > BLOCK):
                        parts = -(-int(count[j]) // BLOCK)
                        own = int(mixed(np.array([name], np.int64).view(U))[0]) % parts
                        pair = np.array([min(own, o) * parts + max(own, o) + 1 for o in range(parts)], U)
                        more.append((mixed(h[j] + pair * U(0x9E3779B97F4A7C15)), np.full(parts, at[j])))
                    keep = count <= BLOCK
                    h, at = np.concatenate([h[keep], *(x for x, _ in more)]), np.concatenate([at[keep], *(x for _, x in more)])
                held.append((h, np.full(len(h), name, np.int64), at))
                size += len(h)
                if size > 500_000:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "bucket int, tokens binary, nodes binary, places binary")


def shared_runs(postings: DataFrame) -> DataFrame:
    """Postings of tokens that at least two sets have: token, home, node, n, pos, level, size of the token's list; each once.

    home is the least node of the token: tokens of one group of near copies mostly share it.
    """

    def run(table: pa.Table) -> pa.Table:
        h, node, at = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("tokens", U), ("nodes", np.int64), ("places", U)))
        order = np.lexsort((node, h))
        h, node, at = h[order], node[order], at[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node, at = h[once], node[once], at[once]
        same = h[1:] == h[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        h, node, at = h[keep], node[keep], at[keep]
        first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        home = node[first][np.cumsum(first) - 1]
        size = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1]
        return pa.table({"size": size.astype(np.int32), "token": long_of(h), "home": home, "node": node, "n": (at >> U(32)).astype(np.int64), "pos": (at >> U(5) & U(2**27 - 1)).astype(np.int64), "level": (at & U(31)).astype(np.int64)})

    return postings.groupBy("bucket").applyInArrow(run, "size int, token long, home long, node long, n long, pos long, level long")


def pair_lister(every: bool, seed: int = 0, members: int = MEMBERS):
    """What lists the pairs of a task's tokens: its memory follows HELD rows and TOLD pairs, however many pairs there are."""

    def pivots(token, node, comp, n, level, *bits):
        """All lists at once: each row outside its list's main component meets ``members`` rows inside; pairs pass the bitmaps, if given.

        Members stand on a ring by hash and a row meets those that follow its own hash, so it meets
        the same ones in most of its lists, and others in the next round.
        """
        run = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
        mix = mixed(comp.view(U) + (token & 3).view(U)) >> U(1)
        ring = mixed(node.view(U) + U(seed * 0x9E3779B97F4A7C15 % 2**64))
        order = np.lexsort((ring, comp, run))
        run, comp, node, n, level, token, mix, ring = (v[order] for v in (run, comp, node, n, level, token, mix, ring))
        first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (comp[1:] != comp[:-1]))))
        size = np.diff(np.append(first, len(run)))
        best = np.lexsort((mix[first], -size, run[first]))
        best = best[np.concatenate(([True], run[first][best][1:] != run[first][best][:-1]))]  # a group per list
        at, count = first[best][run], size[best][run]
        all_outside = np.flatnonzero(comp != comp[at])
        inside = np.flatnonzero(comp == comp[at])  # the main components, in order of list and ring
        stood = run[inside].astype(np.float64) + ring[inside] / 2.0**64
        bits = np.stack(bits)[:, order].view(U) if bits else None
        some = max(TOLD // members, 1)
        for s in range(0, len(all_outside), some):
            outside = all_outside[s : s + some]
            m = np.minimum(members, count[outside])
            x = np.repeat(outside, m)
            j = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            place = np.searchsorted(stood, run[outside] + mixed(ring[outside]) / 2.0**64) - np.searchsorted(run[inside], run[outside])
            y = at[x] + (np.repeat(place, m) + j) % count[x]
            ok = 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
            x, y = x[ok], y[ok]
            if bits is not None:
                d = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in bits)
                x, y = x[7 * d <= n[x] + n[y]], y[7 * d <= n[x] + n[y]]
            yield node[x], node[y], level[x]

    def pairs(token, node, comp, n, pos, level, rank, *bits):
        """All lists at once, for as many sets x at a time as TOLD pairs allow: the pairs of x stay together over its lists."""
        run = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
        order = np.lexsort((node, n, run))
        run, node, comp, n, pos, level, rank = (v[order] for v in (run, node, comp, n, pos, level, rank))
        bits = np.stack(bits)[:, order].view(U)  # bitwise_count takes the absolute value of signed integers
        lx = pos - (n - -(-3 * n // 4)) + 1  # the least l whose probing prefix holds the token
        ly = pos - (n - -(-6 * n // 7)) + 1  # the same for the indexing prefix
        low = np.searchsorted(run << 32 | n, run << 32 | -(-3 * n // 4))
        room = np.where(lx <= level, np.arange(len(node)) - low, 0)
        _, of = np.unique(node, return_inverse=True)
        part = (np.cumsum(np.bincount(of, room)) // TOLD).astype(np.int64)[of]
        rows = np.flatnonzero(room)
        rows = rows[np.argsort(part[rows], kind="stable")]
        for some in np.split(rows, np.flatnonzero(np.diff(part[rows])) + 1):
            out = []
            for i in some:
                y = np.arange(low[i], i)
                need = -(-3 * (n[i] + n[y]) // 7)
                most = np.minimum(rank[i], rank[y]) + 1 + np.minimum(n[i] - pos[i], n[y] - pos[y]) - 1
                y = y[(comp[y] != comp[i]) & (ly[y] <= level[i]) & (most >= need)]
                if len(y):
                    y = y[7 * np.bitwise_count(bits[:, y] ^ bits[:, i : i + 1]).sum(axis=0, dtype=np.int64) <= n[i] + n[y]]
                if len(y):
                    out.append((np.full(len(y), node[i]), node[y], np.full(len(y), level[i])))
            if out:
                yield [np.concatenate(c) for c in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["home", "token", "node", "comp", "n", "level", *(BIT_COLS if members > MEMBERS else [])] if not every else ["home", "token", "node", "comp", "n", "pos", "level", "rank", *BIT_COLS]
        rest = [np.zeros(0, np.int64)] * len(names)

        def found(cols):
            cols = cols[1:]
            token = cols[0]
            if not len(token):
                return
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            mixed_runs = np.minimum.reduceat(cols[2], starts) < np.maximum.reduceat(cols[2], starts)
            keep = np.repeat(mixed_runs, np.diff(np.append(starts, len(token))))
            if not keep.any():
                return
            cols = [c[keep] for c in cols]
            for x, y, level in pairs(*cols) if every else pivots(*cols):
                order = np.lexsort((y, x))
                x, y, level = x[order], y[order], level[order]
                at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))[: len(x)]
                if len(x):
                    told = pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.array(level[at]), pa.array(np.diff(np.append(at, len(x))))], names=["x", "y", "level", "c"])
                    yield from (told.slice(s, SENT) for s in range(0, len(at), SENT))

        for batch in batches:
            cols = [np.concatenate((r, batch.column(c).to_numpy())) for r, c in zip(rest, names, strict=True)]
            new = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            cut = int(new[-1]) + 1 if len(new) else 0  # whole homes, or whole tokens of a large one
            if not cut and len(cols[0]) > HELD:
                cut = int(np.searchsorted(cols[1], cols[1][-1]))
            rest = [c[cut:] for c in cols]
            if cut:
                yield from found([c[:cut] for c in cols])
        yield from found(rest)

    return run


def candidate_pairs(runs: DataFrame, every: bool, seed: int = 0, members: int = MEMBERS) -> DataFrame:
    """Pairs (x, y, level, c) of different components from the lists of tokens.

    every: all pairs that pass the filters, x the larger one, with BIT_COLS in runs; else pivots only, with BIT_COLS if members are more than MEMBERS.
    Lists of one home are in one of PARTS places, so that a pair is told about PARTS times, not
    once per shared token; a home's lists are as many as a prefix has tokens, of BLOCK sets or so.
    """
    at = runs.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int"))
    together = at.repartition(shuffle_width(runs.sparkSession), "home", "part").sortWithinPartitions("part", "home", "token")
    return together.mapInArrow(pair_lister(every, seed, members), "x long, y long, level long, c long")


def differing(p: np.ndarray, q: np.ndarray) -> int:
    """Differing bits of two bitmaps, the wider one folded; at most the tokens only one set has."""
    while len(p) != len(q):
        p, q = sorted((p, q), key=len)
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum(dtype=np.int64))


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that the wide bitmaps don't rule out, with their share of differing bits; no sets travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            wide = zip(batch.column(3), batch.column(5), strict=True)
            d = np.fromiter((differing(np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)) for p, q in wide), np.int64, batch.num_rows)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d / size)], names=["x", "y", "far"])
            yield found.filter(pa.array(7 * d <= size, pa.bool_()))

    end = lambda e: sets.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("wide").alias(f"w{e}"))
    both = pairs.join(end("x"), "x").join(end("y"), "y")
    return both.select("x", "y", "nx", "wx", "ny", "wy").mapInArrow(run, "x long, y long, far double")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold: 100 |x & y| >= 75 |x | y|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = np.sort(np.concatenate((p, q)))
                keep.append(7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select(F.col("node").alias("x"), F.col("members").alias("a")), sets.select(F.col("node").alias("y"), F.col("members").alias("b"))
    return pairs.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(run, "x long, y long")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt by ``key`` to as many tasks as a shuffle has, as a table in the shared folder: joins on it don't shuffle it again."""
    spark = df.sparkSession
    n, name = shuffle_width(spark), f"strata_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/strata/{name}"
    df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.staged_at, out.table = path, name
    return out


def parities(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bitmap of a set as unsigned 64-bit words."""
    odd = (np.bincount((h >> U(40)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(U)


def wide_bits(n: int) -> int:
    """The least power of two of at least two bits a token, from BITS to WIDE."""
    return min(max(1 << (2 * n - 1).bit_length(), BITS), WIDE)


def set_bytes(docs: DataFrame, k: int, salt: int) -> DataFrame:
    """node, size, members and bitmaps of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column(2)[s : s + 500], k))
                bits = np.array([parities(h) for h in sets], U).reshape(len(sets), len(BIT_COLS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(h, salt)[0] for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([parities(h, wide_bits(len(h))).tobytes() for h in sets], pa.binary()), *(pa.array(c) for c in bits.T)], names=["node", "n", "members", "wide", *BIT_COLS])

    return docs.mapInArrow(run, f"node long, n long, members binary, wide binary, {', '.join(f'{c} long' for c in BIT_COLS)}")


def linked_sets(rows: DataFrame, summary: DataFrame, classes: DataFrame, k: int, salt: int) -> DataFrame:
    """(node, component) of all sets that link with another one; component is one of its nodes."""
    spark = rows.sparkSession
    common = bounded_rows(summary.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT), FREQUENT)
    tokens = np.array([r["key"] for r in common], np.int64).view(U)
    counts = np.array([r["n"] for r in common], np.int64)
    order = np.argsort(tokens)

    total = classes.agg(F.sum("n")).first()[0] or 0  # a prefix is about a quarter of its set
    postings = prefix_postings(rows, k, salt, tokens[order], counts[order], max(2 * shuffle_width(spark), total // (4 * BUCKET) + 1))
    shared = staged(shared_runs(postings), "shared")
    by_node = Window.partitionBy("node")
    # x of a pair has n and so base_level at least as large as y: fewer shared tokens than its own
    # base_level rule a set out of all pairs
    enough = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.ceil(F.col("n") * 0.75), F.floor(F.sqrt(F.lit(VERIFY * COMPANY / 4) * F.col("n")))))
    ranked = shared.repartition(shuffle_width(spark), "node").withColumn("rank", (F.row_number().over(by_node.orderBy("pos")) - 1).cast("long")).withColumn("k", F.count(F.lit(1)).over(by_node))
    runs = bucketed(ranked.filter(F.col("k") >= enough).drop("k"), "node")
    discard(shared)
    wanted = classes.join(runs.filter("rank = 0").select("node").distinct(), "node", "left_semi")
    wanted = staged(wanted.select(F.col("first.key").alias("doc_id"), F.col("first.at").alias("at")), "wanted")
    some = rows.join(picked(wanted.select("at")), "at", "left_semi").select("doc_id", "at", "text")  # copies of a row are a node twice, which repeats links
    sets = bucketed(set_bytes(some, k, salt).repartition(shuffle_width(spark), "node"), "node")

    comp, none = None, False
    rounds = [(MEMBERS, BEST, NEAREST)] * PIVOT_ROUNDS + WIDER + [None]
    for round_, step in enumerate(rounds):
        every = step is None
        if none and not every:
            continue
        members, best, nearest = step or rounds[0]
        wider = members > MEMBERS
        now = runs.withColumn("comp", F.col("node")) if comp is None else runs.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        if wider:
            now = now.filter(F.col("size") > LONG)
        if every or wider:
            now = now.join(sets.select("node", *BIT_COLS), "node")
        pairs = candidate_pairs(now, every, round_, members).groupBy("x", "y").agg(F.max("level").alias("level"), F.sum("c").alias("c"))
        if every:
            pairs = pairs.filter("c >= level")
        else:  # a list's pivots are some of a few, so a pair meets in about a quarter of its tokens
            pairs = pairs.filter("4 * c >= level").withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))).filter(F.col("k") <= best)
        near = plausible(pairs.select("x", "y"), sets)
        if not every:
            near = near.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("far", "y"))).filter(F.col("k") <= nearest)
        links = staged(verified(staged(near.select("x", "y"), "pairs"), sets), "links")
        none = links.isEmpty()
        if comp is None:
            comp = components(links)
        elif not none:
            of = lambda end: links.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
            ends = of("x").select("y", "x", F.col("cx"))
            ends = ends.join(comp.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y", "left").select(F.col("cx").alias("x"), F.coalesce("cy", "y").alias("y"))
            merged = components(ends.filter("x <> y"))
            known = comp.select("node", F.col("component").alias("old")).unionByName(merged.select("node", F.col("node").alias("old"))).distinct()
            comp = staged(known.join(merged.select(F.col("node").alias("old"), "component"), "old", "left").groupBy("node").agg(F.min(F.coalesce("component", "old")).alias("component")), "comp")
    discard(runs, wanted, sets)
    for table in (runs, sets):
        spark.sql(f"DROP TABLE IF EXISTS {table.table}")
    return comp


def grouped(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per document: doc_id, at (row key), n, best (no id, id, row key of its group's first row; null without words)."""
    base = id_and_text(docs, id_col, text_col)
    rows = base.select("doc_id", row_key().alias("at"), "text")
    for salt in range(1, 256):
        summary = staged(summarise(rows, k, salt), "summary")
        each = summary.filter("kind = 0")
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "at")).alias("first")
        classes = staged(each.filter("n > 0").groupBy("node").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), (F.min("check") < F.max("check")).alias("clash")), "classes")
        if classes.filter("clash").isEmpty():  # else two sets got one name: name all sets anew
            break
        discard(summary, classes)
    comp = linked_sets(rows, summary, classes, k, salt)

    linked = classes.join(comp, "node").select("node", "component", "first")
    # the groups' rows travel in SALTS copies, as a group may hold a third of all sets
    of_group = linked.groupBy("component").agg(F.min("first").alias("best")).withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(of_group, ["component", "salt"]).select("node", "best")
    label = staged(classes.select("node", "first", "rows").join(linked, "node", "left").select("node", "rows", F.coalesce("best", "first").alias("best")), "label")
    # of sets that more than one in MANY rows have there are fewer than MANY: these few are broadcast
    most = (classes.agg(F.sum("rows")).first()[0] or 0) // MANY
    hot = F.broadcast(label.filter(F.col("rows") > most).select("node", "best"))
    some = each.filter("n > 0")
    parts = [some.join(hot, "node"), some.join(hot.select("node"), "node", "left_anti").join(label.select("node", "best"), "node"), each.filter("n = 0").withColumn("best", F.lit(None).cast(label.schema["best"].dataType))]
    found = [x.select(F.col("key").alias("doc_id"), "at", "n", "best") for x in parts]
    found = staged(found[0].unionByName(found[1]).unionByName(found[2]), "grouped")
    discard(summary, classes, label)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (links: Jaccard of 0.75 or more)."""
    return grouped(docs, id_col, text_col, k).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.key")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; texts without words all stay."""
    found = grouped(docs, id_col, text_col, 5).filter("n > 0")
    first = F.col("doc_id").eqNullSafe(F.col("best.key")) & (F.col("at") == F.col("best.at"))
    kept = without(docs, staged(found.filter(~first).select("doc_id", "at"), "dropped"), id_col, text_col)
    again = staged(found.filter(first).groupBy("doc_id", "at").count().filter("count > 1").select("doc_id", "at"), "repeated")
    if again.isEmpty():
        return kept
    at = (row_key(id_col, text_col) == F.col("__at")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    named = again.select(F.col("doc_id").alias("__id"), F.col("at").alias("__at"))
    repeated = kept.join(named, at, "left_semi").withColumn("__key", row_key(id_col, text_col)).dropDuplicates([id_col, "__key"]).drop("__key")
    return kept.join(named, at, "left_anti").unionByName(repeated)
