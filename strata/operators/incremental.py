"""Incremental extraction over a versioned store: facts, the cache of content hashes and the batch number commit together.

``facts`` only ever gets rows added, each with the path, hash and settings that it came from;
``cache`` holds each (path, hash, config) that was extracted and whether it is what the file holds now
(``live``). A fact counts while the cache says so. A content that comes back counts again without
being extracted again. A batch is committed in one manifest, with its number: if a job dies before
that, nothing has happened and the batch runs again; if it dies after, the repeated batch is seen
by its number and skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.sources.staging import staged

from .versions import Version, VersionedStore

CACHE = "path string, hash string, config string, live boolean"
KEY = ["path", "hash", "config"]


def live_facts(store: VersionedStore, version: Version | None = None) -> DataFrame:
    """Facts of files as they are now."""
    version = store.version() if version is None else version
    return store.read("facts", version).join(store.read("cache", version).filter("live"), KEY, "left_semi")


def extract_batch(store: VersionedStore, files: DataFrame, extract: Callable[[DataFrame], DataFrame], config: str, batch: int, whole: bool = False) -> Version:
    """Extracts the files (path, hash, and what ``extract`` reads) that the cache doesn't know under ``config``.

    ``extract`` gives rows with a column path. A file with ``hash`` null was deleted; with ``whole``
    the batch is the whole tree and files that it lacks are deleted too. Of repeated paths in a batch
    one row with the largest hash counts. A batch number that was committed already changes nothing.
    """
    base = store.version()
    if batch <= base.notes.get("batch", -1):
        return base
    spark = store.spark
    cache = store.read("cache", base) if "cache" in base.tables else spark.createDataFrame([], CACHE)
    seen = staged(files.groupBy("path", "hash").agg(F.count(F.lit(1)).alias("rows")).groupBy("path").agg(F.max("hash").alias("hash"), F.max_by("rows", "hash").alias("rows")).withColumn("config", F.lit(config)), "batch")
    now = seen.filter("hash is not null").select(*KEY, "rows")
    changed = staged(now.join(cache, KEY, "left_anti"), "changed")
    said = seen.select("path", F.col("hash").alias("new"), F.col("config").alias("under"))
    named = F.coalesce((F.col("hash") == F.col("new")) & (F.col("config") == F.col("under")), F.lit(False))
    live = named if whole else F.when(F.col("under").isNull(), F.col("live")).otherwise(named)
    entries = {"cache": store.write(cache.join(said, "path", "left").select(*KEY, live.alias("live")).unionByName(changed.select(*KEY, F.lit(True).alias("live"))))}
    # contents stream past hashed keys: only those of paths that were given more than once are sorted
    work = files.join(changed.select("path", "hash", "rows").hint("shuffle_hash"), ["path", "hash"])
    if not changed.filter("rows > 1").isEmpty():
        work = work.filter("rows = 1").unionByName(work.filter("rows > 1").dropDuplicates(["path"]))
    entries["facts"] = store.append("facts", extract(work.drop("rows")).join(changed.select(*KEY), "path"), base)
    return store.commit(entries, base, {"batch": batch})


def compacted(store: VersionedStore) -> Version:
    """Rewrites both tables without what no longer counts."""
    base = store.version()
    return store.commit({"facts": store.write(live_facts(store, base)), "cache": store.write(store.read("cache", base).filter("live"))}, base)


def extraction_stream(files: DataFrame, store: VersionedStore, extract: Callable[[DataFrame], DataFrame], config: str, checkpoint: str) -> StreamingQuery:
    """``extract_batch`` for every micro-batch of a stream of files."""

    def each(batch: DataFrame, number: int) -> None:
        extract_batch(store, batch, extract, config, number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
