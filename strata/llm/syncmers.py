"""Document fingerprints of closed syncmers, with DataFrame functions only.

A k-mer of ``K`` words is an anchor (a closed syncmer) if the smallest hash among its word
pairs lies at either edge. That depends on the k-mer alone, so equal passages give equal
anchors wherever they stand. A fingerprint is the sequence of all anchors in text order, eight
hex digits each, so that fingerprints can be matched by position; likeness is the Dice
coefficient of the distinct anchors of two texts.

Each document is also compared with its neighbour, the next one by descending id. Neighbours
are found without a global sort: ids are cut into ranges, each range's first row is also sent
to the range before it, and ``lead`` runs inside ranges.

Defined cases: null text counts as empty; an empty text has an empty fingerprint and is like
another empty one (1.0) and unlike all others (0.0); a text of fewer than ``K`` words, or one
in which no k-mer is an anchor, has one anchor, the hash of its whole text; repeated rows follow each other in the order (descending id,
text); a single row is its own neighbour; null ids come last; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, hex_of, id_and_text, shuffle_width

#: Words of a k-mer; its word pairs are the inner substrings.
K = 8
#: Most ranges of ids; their first rows are what the driver gets.
RANGES = 8_192


def with_anchors(df: DataFrame, text_col: str, to: str) -> DataFrame:
    """Adds ``to``: the 32-bit anchors of a text, in order."""
    words = F.split(F.trim(F.col(text_col)), r"[\x09-\x0D\x20]+")
    df = df.withColumn("__w", words)
    w = F.col("__w")
    df = df.withColumn("__h", F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))))
    h = F.col("__h")
    edge = lambda i: F.least(F.get(h, i), F.get(h, i + K - 2)) <= F.least(*(F.get(h, i + j) for j in range(1, K - 2)))
    at = F.filter(F.sequence(F.lit(0), F.size(h) - (K - 1)), edge)
    short = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(0xFFFFFFFF))
    df = df.withColumn("__a", F.when(h.isNotNull(), F.transform(at, lambda i: short(*(F.get(h, i + j) for j in range(K - 1))))))
    whole = F.when(F.length(text_col) > 0, F.array(short(F.col(text_col)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(to, F.when(F.size("__a") > 0, F.col("__a")).otherwise(whole)).drop("__w", "__h", "__a")


def shown(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """2 |a & b| / (|a| + |b|) over distinct anchors."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def id_ranges(rows: DataFrame, ranges: int) -> list[int]:
    """Cut points of the ids, at most ``ranges``; found from a bounded quantile sketch."""
    p = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", p, 100 * ranges)).first()[0]
    return sorted(set(cuts or []))


def in_ranges(rows: DataFrame, ranges: int) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """Rows with their part, parts in descending order of ids, and each part's largest id."""
    cuts = id_ranges(rows, max(2, min(ranges, RANGES)))
    above = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    # the ids above the last cut are in part 0; nulls come after all others
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - above)
    ranged = rows.withColumn("part", place.cast("int"))
    first = sorted((r["part"], r["top"]) for r in bounded_rows(ranged.select("doc_id", "part").groupBy("part").agg(F.max("doc_id").alias("top")), RANGES + 2))
    return ranged, first


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = id_and_text(docs, id_col, text_col)
    ranged, first = in_ranges(rows, width)
    parts = [p for p, _ in first]
    # the part before each one, in a circle; the first row of a part is shown to it as a ghost
    ghosts = {p: parts[i - 1] for i, p in enumerate(parts)}
    tops = {p: t for p, t in first}
    if first:
        table = F.create_map(*(F.lit(x) for p in parts for x in (p, ghosts[p])))
        top = F.create_map(*(x for p in parts for x in (F.lit(p), F.lit(tops[p]).cast("long"))))
        heads = ranged.filter(F.col("doc_id").eqNullSafe(F.element_at(top, F.col("part"))))
        # of repeated rows with the top id the first text alone is the ghost; one row per part
        heads = heads.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
        heads = heads.select("doc_id", "text", F.element_at(table, F.col("part")).alias("part"), F.lit(1).alias("ghost"))
        ranged = ranged.withColumn("ghost", F.lit(0)).unionByName(heads)
    else:
        ranged = ranged.withColumn("ghost", F.lit(0))
    dealt = with_anchors(ranged.repartition(width, "part"), "text", "anchors")
    w = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    after = dealt.withColumn("next", F.lead(F.struct("text", "anchors")).over(w)).filter("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = after.withColumn("edited", edited).withColumn("next_anchors", F.col("next.anchors")).drop("next")
    out = with_anchors(out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "anchors", "next_anchors", "edited"), "edited", "edited_anchors")
    return out.select(
        "doc_id", "n_chars", hex_of(F.col("edited")).alias("edited_sha256"), shown("anchors").alias("fingerprint"), shown("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"),
    )
