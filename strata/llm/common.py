"""Helpers shared by the corpus operators: staging, ids, row shapes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset on a local master
    (tests on one machine) a temporary folder of this process takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="strata-")
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation, and gives
    the optimizer a measured size, so that Spark's own threshold decides about broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, null text as empty; other columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(id_col: str | Column = "doc_id", text_col: str | Column = "text") -> Column:
    """A 64-bit key of a row's id and text, null text as empty: with the id it addresses a row."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.xxhash64(as_col(id_col).cast("long"), F.coalesce(as_col(text_col).cast("string"), F.lit("")))


#: Most row keys that are broadcast to pick texts, 16 bytes each; more are joined by a shuffle.
PICKED = 1_000_000


def picked(rows: DataFrame, most: int = PICKED) -> DataFrame:
    """``rows`` (staged) as a broadcast while they are at most ``most``: keeps whole texts out of a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named by ``rows`` (staged; doc_id, at: their row key); all columns stay.

    Null ids are addressed as well, and another text of the same id is left alone.
    """
    gone = rows.select(F.col("doc_id").alias("__gone_id"), F.col("at").alias("__gone_at"))
    return docs.join(picked(gone), (row_key(id_col, text_col) == F.col("__gone_at")) & F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")), "left_anti")


def bounded_rows(df: DataFrame, bound: int) -> list:
    """Collects a table whose size has a proven bound; more rows are an error, never a cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"expected at most {bound} rows")
    return rows


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex_of(text: Column) -> Column:
    """Lower-case SHA-256 hex of a string's UTF-8 bytes."""
    return F.sha2(text, 256)
