"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Tables written once per application: (application, name, key) to path and schema.
ONCE: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of this process only where that is unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="strata-")
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/strata/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task of ``dealt``.
DEALT = 100_000


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """``df`` (staged) by ``keys`` in as many tasks as its rows need: a distinct or groupBy of these keys is then done in place.

    Without it each task that reads the table first groups all its rows, in memory that grows with the table.
    """
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)
    return df.repartition(width, *keys)


def once(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written when first asked for and read from then on.

    ``key`` names what it was made from (a folder); a source that changes under the same key within one application isn't seen.
    """
    at = (spark.sparkContext.applicationId, name, key)
    if at not in ONCE:
        df = build()
        path = f"{shared_dir(spark)}/strata/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        ONCE[at] = (path, df.schema)
    path, schema = ONCE[at]
    return spark.read.schema(schema).parquet(path)


def once_at(spark: SparkSession, name: str, key: str) -> str:
    """The folder of a table that ``once`` has written."""
    return ONCE[spark.sparkContext.applicationId, name, key][0]
