"""A stored search index: postings in blocks by token and group of documents, kept over queries and updated by document.

``blocks`` holds one row per token, group of documents and generation: ids, weights and document lengths
as arrays, and what bounds their scores, the largest weight and the smallest length. Rows are sorted by
token, so a prefix reads a range of the files; the bounds are read without the arrays, and arrays
only of groups that can still reach the k best. ``docs`` holds each document's length and generation.
New and changed documents are added as blocks of a new generation; postings of an older generation of a document no
longer count. All of it is versioned: a search reads one version, an update commits a new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sources.staging import DEALT, dealt, staged

from .search import B, K1, LEAST_IDF, field_postings, in_order
from .versions import Version, VersionedStore

#: Documents of one group.
GROUP = 512
#: Scores closer than this to the k-th are kept, for orders that round them.
SLACK = 1e-8
#: Share of the groups that a search scores first.
FIRST = 0.02


class TextIndex:
    """Prefix BM25 over documents (id, and the columns of ``weights``) of a store's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, VersionedStore(spark, path)

    def _blocks(self, docs: DataFrame, weights: dict[str, float], groups: int | None, gen: int) -> tuple[DataFrame, DataFrame, int]:
        """Blocks, lengths and the number of groups, by the number of documents if not given; tasks grow in number with the postings, not in size."""
        rows = staged(field_postings(docs, "id", weights), "rows")
        one = dealt(rows, "id").groupBy("id", "token").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        p = staged(one.withColumn("len", F.sum("n").over(Window.partitionBy("id"))), "postings")
        lengths = staged(p.filter("token = ''").select("id", "len", F.lit(gen).alias("gen")), "lengths")
        groups = groups or max(1, math.ceil(lengths.count() / GROUP))
        each = p.filter("token <> ''").withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        listed = F.sort_array(F.collect_list(F.struct("id", "w", "len")))  # a group's documents, at most about GROUP
        b = dealt(each, "token", "grp").groupBy("token", "grp").agg(listed.alias("r"), F.max("w").alias("most"), F.min("len").alias("short"))
        b = staged(b.select("token", "grp", F.lit(gen).alias("gen"), F.size("r").alias("n"), "most", "short", *(F.col(f"r.{c}").alias(to) for c, to in (("id", "ids"), ("w", "ws"), ("len", "lens")))), "blocks")
        return b.repartitionByRange(p.count() // (2 * DEALT) + 1, "token", "grp").sortWithinPartitions("token", "grp"), lengths, groups

    def _notes(self, docs: DataFrame, more: dict) -> dict:
        one = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return more | {"docs": one[0], "words": int(one[1])}

    def build(self, docs: DataFrame, weights: dict[str, float]) -> Version:
        """The whole index anew. Repeated ids are one document with all their words."""
        base = self.store.version()
        blocks, lengths, groups = self._blocks(docs, weights, None, 0)
        entries = {"blocks": self.store.write(blocks), "docs": self.store.write(lengths), "changed": self.store.write(lengths.limit(0).select("id", "gen"))}
        return self.store.commit(entries, base, self._notes(lengths, {"weights": weights, "groups": groups, "gen": 0}))

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> Version:
        """Documents (id, columns) new or changed, and ids of those that are gone; nothing else is read but the lengths."""
        base = self.store.version()
        gen = base.notes["gen"] + 1
        blocks, lengths, _ = self._blocks(docs, base.notes["weights"], base.notes["groups"], gen)
        marks = lengths.select("id", "gen")
        if gone is not None:
            marks = marks.unionByName(gone.select("id", F.lit(gen).alias("gen")).join(lengths.select("id"), "id", "left_anti").distinct())
        marks = staged(marks, "marks")
        keep = self.store.read("docs", base).join(marks.select("id"), "id", "left_anti").unionByName(lengths)
        changed = self.store.read("changed", base).join(marks.select("id"), "id", "left_anti").unionByName(marks)
        entries = {"blocks": self.store.append("blocks", blocks, base), "docs": self.store.write(keep), "changed": self.store.write(changed)}
        return self.store.commit(entries, base, self._notes(self.store.read("docs", Version(0, entries)), {"gen": gen}))

    def _live(self, x: DataFrame, version: Version) -> DataFrame:
        """Postings (id, gen) without those of older generations of changed documents."""
        if not version.notes["gen"]:
            return x
        newer = self.store.read("changed", version).select("id", F.col("gen").alias("newest"))
        return x.join(newer, "id", "left").filter("newest is null or gen = newest").drop("newest")

    def plan(self, query: list[str], k: int) -> tuple[DataFrame, DataFrame, Version]:
        """Headers of the query's blocks with the bound of each group, idf by query token, and the version they hold for."""
        version = self.store.version()
        blocks = self.store.read("blocks", version)
        near = None
        for t in query:
            one = (F.col("token") >= t) & (F.col("token") < t + chr(0x10FFFF))
            near = one if near is None else near | one
        q = F.explode(F.filter(F.array(*(F.lit(t) for t in query)), lambda t: F.col("token").startswith(t))).alias("q")
        heads = staged(blocks.filter(near).select("token", "grp", "gen", "n", "most", "short", q), "heads")
        # documents of a prefix: of one token the sum of its blocks, of several their distinct ids
        many = heads.groupBy("q").agg(F.countDistinct("token").alias("tokens"), F.sum("n").alias("n_q"))
        plain = F.col("tokens") == 1 if not version.notes["gen"] else F.lit(False)
        wide = [r["q"] for r in many.filter(~plain).select("q").collect()]  # query tokens
        exact = many.filter(plain).select("q", "n_q")
        if wide:
            cover = None
            for t in wide:
                one = (F.col("token") >= t) & (F.col("token") < t + chr(0x10FFFF))
                cover = one if cover is None else cover | one
            some = F.explode(F.filter(F.array(*(F.lit(t) for t in wide)), lambda t: F.col("token").startswith(t))).alias("q")
            ids = self._live(blocks.filter(cover).select("gen", "ids", some).select("q", "gen", F.explode("ids").alias("id")), version)
            exact = exact.unionByName(ids.groupBy("q").agg(F.countDistinct("id").alias("n_q")))
        n = version.notes["docs"]
        idf = F.log((F.lit(n) - F.col("n_q") + 0.5) / (F.col("n_q") + 0.5))
        idf = staged(exact.select("q", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf")), "idf")
        # the score of summed weights is at most the sum of their scores
        bound = heads.join(idf, "q").groupBy("grp").agg(F.sum(self._part(F.col("most"), F.col("short"), version)).alias("bound"), F.sum("n").alias("n"))
        return staged(bound, "bounds"), idf, version

    def _part(self, f: Column, length: Column, version: Version) -> Column:
        mean = max(version.notes["words"], 1) / max(version.notes["docs"], 1)
        return F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))

    def _scored(self, query: list[str], groups: DataFrame, idf: DataFrame, version: Version) -> DataFrame:
        near = None
        for t in query:
            one = (F.col("token") >= t) & (F.col("token") < t + chr(0x10FFFF))
            near = one if near is None else near | one
        q = F.explode(F.filter(F.array(*(F.lit(t) for t in query)), lambda t: F.col("token").startswith(t))).alias("q")
        x = self.store.read("blocks", version).filter(near).join(groups.select("grp"), "grp", "left_semi").select("gen", q, F.arrays_zip("ids", "ws", "lens").alias("r"))
        x = self._live(x.select("gen", "q", F.explode("r").alias("r")).select("gen", "q", "r.ids", "r.ws", "r.lens").toDF("gen", "q", "id", "w", "len"), version)
        x = x.groupBy("id", "q", "len").agg(F.sum("w").alias("f")).join(idf, "q")
        return x.groupBy("id").agg((-in_order("q", self._part(F.col("f"), F.col("len"), version))).alias("score"), F.count(F.lit(1)).alias("matched"))

    def search(self, query: list[str], k: int) -> DataFrame:
        """(id, score, matched) of the k best documents and of all that are within SLACK of the k-th; more negative is better."""
        query = list(dict.fromkeys(query))
        if not query:
            return self.store.read("docs").select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")).limit(0)
        bounds, idf, version = self.plan(query, k)
        first = bounds.orderBy(F.desc("bound"), "grp").limit(max(1, math.ceil(version.notes["groups"] * FIRST)))
        scored = staged(self._scored(query, first, idf, version), "scored")
        kth = scored.orderBy("score").select("score").limit(k).agg(F.count(F.lit(1)), F.max("score")).first()
        rest = bounds.join(first.select("grp"), "grp", "left_anti")
        if kth[0] == k:
            rest = rest.filter(F.col("bound") >= -kth[1] - SLACK)
        out = scored if rest.isEmpty() else staged(scored.unionByName(self._scored(query, rest, idf, version)), "scored")
        last = out.orderBy("score").select("score").limit(k).agg(F.max("score")).first()[0]
        return out if last is None else out.filter(F.col("score") <= last + SLACK)

    def postings_read(self, query: list[str], k: int) -> tuple[int, int]:
        """Postings in the groups that a search scores, and all of the index."""
        query = list(dict.fromkeys(query))
        bounds, idf, version = self.plan(query, k)
        first = bounds.orderBy(F.desc("bound"), "grp").limit(max(1, math.ceil(version.notes["groups"] * FIRST)))
        kth = self._scored(query, first, idf, version).orderBy("score").limit(k).agg(F.count(F.lit(1)), F.max("score")).first()
        need = bounds if kth[0] < k else bounds.filter(F.col("bound") >= -kth[1] - SLACK).unionByName(first).dropDuplicates(["grp"])
        return need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], self.store.read("blocks", version).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
