"""Places in an order over all rows, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in an order: ranges of the order are sorted each on its own, and each starts after
    the rows of those before. Rows equal in all of the order share a range and are numbered in any way."""
    part, base = f"{name}_part", f"{name}_base"
    ranged = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    heads = ranged.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(heads), part).withColumn(name, F.col(name) + F.col(base)).drop(part, base)
