"""Exact deduplication by a tree-merge of sorted digest runs.

Every row is assigned to one of ``runs`` leaf runs by a hash of its id. A leaf run holds one
entry per distinct text (digest, smallest identifier, count), sorted by digest. In each round
``fan_in`` neighbouring runs are exchanged and merged into their parent run: entries with the
same digest meet, are verified, and only the smallest identifier survives with the summed
count. After log(runs)/log(fan_in) rounds one logical run is left; it stays spread over the
cluster by digest, so the root is never one task. The winners then travel the same tree
downwards, so a text with a billion copies is at most ``fan_in`` entries per key on every
level and its rows are spread over all leaf runs: no step gathers a group of copies.

Verification: an entry's key is the SHA-256 digest, the byte length and an independent 64-bit
hash together. Entries merge only if all three agree, so a digest clash would be kept apart.

Defined cases: null text counts as empty; empty texts are equal to each other; rows with the
same id and the same text are copies of each other and share their decision (``kept`` is true
for each of them if the id is the group's winner); a null id never wins while a non-null id
exists; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PICKED, hex_of, id_and_text, picked, staged

KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, leaf run and verification key of each row; the only pass over the texts."""
    text = F.col("text")
    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text, F.lit(7)).alias("check"),
    )


def tree_merge(rows: DataFrame, keep: str = "smallest", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """Adds keep_id and group_size to rows of (doc_id, run, digest, n_bytes, check)."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    leaf = rows.groupBy("run", *KEY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [staged(leaf.sortWithinPartitions("run", "digest"), "run0")]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        merged = (
            levels[-1]
            .withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        levels.append(staged(merged.sortWithinPartitions("run", "digest"), f"run{len(levels)}"))
    won = levels.pop()
    while levels:
        child = levels.pop().drop("keep_id", "group_size").withColumn("parent", F.floor(F.col("run") / fan_in).cast("int"))
        won = child.join(won.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return rows.join(won, ["run", *KEY])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(docs, runs, id_col, text_col), "digests")
    return tree_merge(rows, keep, runs, fan_in).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts; repeated rows collapse to one.

    Rows are addressed by id and text together, null ids included, so a dropped copy never takes
    another text of the same id with it. Null and empty text are one text.
    """
    found = exact_duplicates(docs, id_col, text_col, keep)
    sha = hex_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    address = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of")]
    at = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (sha == F.col("__of"))
    # an address is about four times as large as a row key
    kept = docs.join(picked(staged(found.filter(~F.col("kept")).select(*address), "copies"), PICKED // 4), at, "left_anti")
    again = staged(found.filter("kept").groupBy(*address).count().filter("count > 1").select("__id", "__of"), "repeated")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, at, "left_semi").withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return kept.join(again, at, "left_anti").unionByName(repeated)
