"""Joins of many patterns with many texts that contain them, as equi-joins on q-grams.

A text that contains a pattern has every q-gram of it, so a pattern need only meet the texts that
have the one of its q-grams that the fewest texts have; a pattern shorter than q meets the texts
by itself. Only q-grams that some pattern has leave a text, and candidates are verified. Texts never
meet all patterns, nothing is broadcast by hand, and a frequent q-gram costs something only to
patterns that have no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import basename
from strata.sources.staging import staged

Q = 3


def grams(text: Column, length: int) -> Column:
    """Distinct substrings of ``length`` characters."""
    n = F.length(text) - length + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame, q: int = Q) -> DataFrame:
    """(id, pattern) of each text (id, text) and distinct pattern (pattern) that it contains, case-sensitive.

    The empty pattern is in every text that isn't null; null texts and patterns match nothing;
    repeated ids with the same text give one row.
    """
    texts = texts.select("id", "text").filter("text is not null")
    patterns = staged(patterns.select("pattern").filter("pattern is not null").distinct(), "patterns")
    lengths = sorted(r[0] for r in patterns.select(F.least(F.length("pattern"), F.lit(q))).distinct().collect())  # at most q + 1 numbers
    parts = [texts.crossJoin(patterns.filter("pattern = ''")).select("id", "pattern")] if 0 in lengths else []  # one pattern
    for n in (n for n in lengths if n):
        some = patterns.filter(F.least(F.length("pattern"), F.lit(q)) == n)
        keys = some.select("pattern", F.explode(grams(F.col("pattern"), n)).alias("gram"))
        had = texts.select("id", "text", F.explode(grams(F.col("text"), n)).alias("gram")).select("id", F.xxhash64("text").alias("t"), "gram")
        had = staged(had.join(keys.select("gram").distinct(), "gram", "left_semi"), "grams")
        often = had.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # a pattern with a gram that no text has is in no text
        anchor = keys.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0").select("pattern", "gram")
        meet = had.join(anchor, "gram").select("id", "t", "pattern")
        if n < q:
            parts.append(meet.select("id", "pattern"))  # the gram is the pattern
        else:
            whole = texts.withColumn("t", F.xxhash64("text"))
            parts.append(meet.join(whole, ["id", "t"]).filter(F.col("text").contains(F.col("pattern"))).select("id", "pattern"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return texts.select("id", F.col("text").alias("pattern")).limit(0) if out is None else out.distinct()


def texts_with(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): as ``containing`` for distinct short texts (text) that are their own ids."""
    x = texts.select("text").filter("text is not null").distinct()
    return containing(x.select(F.col("text").alias("id"), "text"), patterns).select(F.col("id").alias("text"), "pattern")


def related_paths(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, file) where one path holds the other, or the file ends in the target's name; empty files meet nothing."""
    t, f = targets.select("target").filter("target is not null").distinct(), files.select("file").filter("file <> ''").distinct()
    names = t.select("target", basename(F.col("target")).alias("pattern"))
    into_files = texts_with(f.withColumnRenamed("file", "text"), names.select("pattern").unionByName(t.withColumnRenamed("target", "pattern")))
    asked = names.withColumn("end", F.lit(True)).unionByName(t.select("target", F.col("target").alias("pattern"), F.lit(False).alias("end")))
    into_files = into_files.join(asked, "pattern").filter(~F.col("end") | F.col("text").endswith(F.col("pattern"))).select("target", F.col("text").alias("file"))
    up = texts_with(t.withColumnRenamed("target", "text"), f.withColumnRenamed("file", "pattern")).select(F.col("text").alias("target"), F.col("pattern").alias("file"))
    return into_files.unionByName(up).distinct()
