"""Structured Streaming over event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.store import changed_files


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_in_ttl(stream: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "30 seconds") -> DataFrame:
    """The first of equal calls within the watermark of ``ttl``."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def debounced(stream: DataFrame, key: str, ts: str = "ts", gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Trailing-edge debounce: one row per session of a key; its end is when it fires."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.end").alias("fires_at"), "n")


def windowed_counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    s = stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("window.start").alias("start"), key, "n")


def incremental_extract(files: DataFrame, cache: Callable[[], DataFrame], extract: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``extract`` on files whose (path, hash) isn't cached yet, micro-batch by micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(extract(changed_files(batch, cache())), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
