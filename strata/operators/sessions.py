"""Response caches over an event list: an entry lives for a TTL from the miss that made it.

A call is a hit while the last miss of its key is less than the TTL ago, so misses form a chain: each
is followed by the first call at least a TTL later. The chain is found without walking any key row
by row. Calls are first reduced to distinct times per key. The first call at least a TTL later is
looked up within (key, TTL-wide bucket) groups, so no group is larger than what happens within one
TTL. Calls after a pause of a TTL are misses whatever came before; from these the chains between
them are marked by pointer doubling, in rounds that grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.staging import staged

#: Buckets of one key that are ordered in one group.
SPAN = 4096


def cache_key(*columns: str | Column) -> Column:
    """One string for the values of a key; a null differs from an empty value."""
    return F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("")) for c in columns)))


def next_bucket(buckets: DataFrame) -> DataFrame:
    """(k, b, first) to the first time of the key's next bucket that isn't empty (``after``), by spans of buckets."""
    x = buckets.withColumn("span", F.floor(F.col("b") / SPAN))
    spans = x.groupBy("k", "span").agg(F.min_by("first", "b").alias("first"), F.min("b").alias("b0"))
    w = Window.partitionBy("k").orderBy("span")
    spans = spans.select("k", "span", F.lead("first").over(w).alias("far"), F.lead("b0").over(w).alias("far_b"))
    w = Window.partitionBy("k", "span").orderBy("b")
    x = x.withColumn("near", F.lead("first").over(w)).withColumn("near_b", F.lead("b").over(w))
    return x.join(spans, ["k", "span"]).select("k", "b", F.coalesce("near", "far").alias("after"), F.coalesce("near_b", "far_b").alias("after_b"))


def ttl_misses(calls: DataFrame, ttl: int) -> DataFrame:
    """(k, t) of the misses among calls (k, t in microseconds), each time of a key once; ``ttl`` in microseconds."""
    bucket = lambda t: F.expr(f"({t} - pmod({t}, {ttl})) div {ttl}")
    ticks = staged(calls.select("k", "t").distinct().withColumn("b", bucket("t")), "ticks")
    buckets = staged(ticks.groupBy("k", "b").agg(F.min("t").alias("first"), F.max("t").alias("last")), "buckets")
    # a bucket's first call is a miss when the bucket before has none within the TTL
    before = buckets.select("k", (F.col("b") + 1).alias("b"), F.col("last").alias("before"))
    roots = staged(buckets.join(before, ["k", "b"], "left").filter(f"before is null or first - before >= {ttl}").select("k", F.col("first").alias("t")), "roots")
    # the first call at or after t + ttl: in the next bucket, else the first of the next non-empty one
    both = ticks.select("k", "b", F.col("t").alias("at"), F.lit(0).alias("probe")).unionByName(ticks.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + ttl).alias("at"), F.lit(1).alias("probe")))
    w = Window.partitionBy("k", "b").orderBy(F.desc("at"), "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.min(F.when(F.col("probe") == 0, F.col("at"))).over(w)).filter("probe = 1").select("k", (F.col("b") - 1).alias("b"), (F.col("at") - ttl).alias("t"), "near")
    ways = staged(next_bucket(buckets), "ways")
    one = near.join(ways, ["k", "b"])
    two = ways.select("k", F.col("b").alias("after_b"), F.col("after").alias("second"))
    far = F.when(F.col("after_b") == F.col("b") + 1, F.col("second")).otherwise(F.col("after"))
    jump = one.join(two, ["k", "after_b"], "left").select("k", "t", F.coalesce("near", far).alias("to")).filter("to is not null")
    jump = staged(jump.join(roots.withColumnRenamed("t", "to"), ["k", "to"], "left_anti").select("k", "t", "to"), "jumps")
    miss = roots
    while True:
        new = staged(miss.join(jump, ["k", "t"]).select("k", F.col("to").alias("t")).distinct().join(miss, ["k", "t"], "left_anti"), "misses")
        if new.isEmpty():
            return miss
        miss = miss.unionByName(new)
        onward = jump.select("k", F.col("t").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(onward, ["k", "to"]).select("k", "t", F.col("further").alias("to")), "jumps")


def cache_hits(events: DataFrame, key: list[str], ts: str, order: str, ttl_seconds: int = 30) -> DataFrame:
    """``events`` with the column ``hit``; of calls at the same time the one with the smallest ``order`` may miss.

    Rows without a time are neither (``hit`` null). Repeated rows are calls of their own: only one of equal ones misses.
    """
    x = events.withColumn("__k", cache_key(*key)).withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    miss = ttl_misses(x.filter("__t is not null").select(F.col("__k").alias("k"), F.col("__t").alias("t")), ttl_seconds * 1_000_000)
    first = Window.partitionBy("__k", "__t").orderBy(order)
    x = x.withColumn("__n", F.row_number().over(first)).join(miss.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.lit(True).alias("__miss")), ["__k", "__t"], "left")
    hit = F.when(F.col("__t").isNotNull(), ~(F.coalesce("__miss", F.lit(False)) & (F.col("__n") == 1)))
    return x.withColumn("hit", hit).drop("__k", "__t", "__n", "__miss")


def session_metrics(events: DataFrame, tokens: Column, hit: Column, key: list[str] | None = None, usual: int = 400) -> DataFrame:
    """Calls, tokens, tokens saved against ``usual`` per call (0 at least), their ratio in per cent, cache hits."""
    x = events.groupBy(*(key or [])).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.count(F.when(hit, 1)).alias("cache_hits"))
    saved = F.greatest(F.col("calls") * usual - F.col("tokens"), F.lit(0))
    ratio = F.when(F.col("calls") > 0, F.concat(F.floor(saved / (F.col("calls") * usual) * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("n/a")
    return x.select(*(key or []), "calls", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(saved, F.lit(0)).alias("saved"), ratio.alias("ratio"), "cache_hits")
