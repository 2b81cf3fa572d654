"""Keyed tables, logs and set similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.staging import staged

from .versions import VersionedStore

#: Name of the one table of a folder that ``full_refresh`` writes.
TABLE = "data"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def tail(log: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """The newest n rows, newest first; a distributed top-n, not a global sort."""
    return log.orderBy(F.desc(key)).limit(n)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, as an aggregate with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def changed_files(files: DataFrame, cache: DataFrame, config: str | None = None) -> DataFrame:
    """Files (path, hash) whose content isn't in the cache yet; ``config`` is the hash of the settings that entries must have."""
    known = cache if config is None else cache.filter(F.col("config") == config)
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def live_entries(cache: DataFrame, files: DataFrame, config: str) -> DataFrame:
    """Entries that still hold: same settings, same content, file still there; all others are evicted."""
    return cache.filter(F.col("config") == config).join(files.select("path", "hash"), ["path", "hash"], "left_semi")


def full_refresh(df: DataFrame, path: str) -> None:
    """Replaces a whole table; readers keep the old one, and a refresh that fails changes nothing. See ``versions``."""
    VersionedStore(df.sparkSession, path).refresh(TABLE, df)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``full_refresh`` wrote last, pinned."""
    return VersionedStore(spark, path).read(TABLE)


def point(df: DataFrame, **keys) -> DataFrame:
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    return df


def listed(df: DataFrame, key: str, **keys) -> DataFrame:
    return point(df, **keys).select(key).orderBy(key)


def backend_of(spark: SparkSession, table: str, folder: str) -> str:
    """'table' if the catalog or the versioned store in ``folder`` has it, else 'files'."""
    return "table" if spark.catalog.tableExists(table) or table in VersionedStore(spark, folder).version().tables else "files"


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, similarity) of sets (k, a) of equal size with Jaccard of at least ``least``.

    Equal sets are one set while candidates are sought: distinct sets meet by their rarest members
    only. Empty sets are like nothing.
    """
    from .code import named_sets, near_classes, owners

    x = sets.filter(F.size("a") > 0).select(F.col("k").alias("id"), F.col("a").alias("members"))
    of, distinct = (staged(y, n) for y, n in zip(named_sets(x), ("set_of", "distinct_sets"), strict=True))
    near = staged(near_classes(distinct.select(F.col("id").alias("set"), F.col("id").alias("class")), distinct, least, 6, equal_sizes=True), "near_sets")
    return owners(near, of.withColumnRenamed("set", "class"))
