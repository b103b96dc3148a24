"""Consecutive numbers for rows without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def numbered(df: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """df with a BIGINT column that counts its rows from start, in the order given (else as they come).

    The rows are sorted by range and checkpointed, so that lost executors change no number; one count a partition comes to
    the driver and gives each its first number.
    """
    shared_folder(df.sparkSession)
    rows = (df.orderBy(*order) if order else df).checkpoint()
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    first, at = [], start
    for part, n in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        first.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(first, "_part int, _start bigint")  # a row a partition
    rows = rows.join(F.broadcast(starts), "_part")
    number = (F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33) + F.col("_start")).cast("bigint")
    return rows.select(number.alias(name), *df.columns)
