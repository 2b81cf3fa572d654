"""Row numbers of a whole table in order, without a window over all of it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.staging import staged


def numbered(df: DataFrame, order: list[Column], to: str = "n") -> DataFrame:
    """``df`` with numbers from 1 in ``order`` (ascending columns) in the column ``to``.

    Rows are dealt to tasks by ranges of the order, numbered within their range, and moved by the number
    of rows in the ranges before; only the ranges' sizes, one row per task, meet in one place. Rows
    that are equal in all of ``order`` share a range: name enough columns to tell rows apart.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    x = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    # the ranges come from a sample, so they are written once before they are counted and numbered
    x = staged(x.repartitionByRange(*(F.col(k) for k in keys)).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = x.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) + F.col("__before")
    return x.join(sizes.select("__range", before.alias("__before")), "__range").select(*df.columns, at.cast("long").alias(to))
