"""Distributed scans: places in a global order and running sums, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save

_ROW = (1 << 33) - 1  # monotonically_increasing_id() holds the partition above this, the row below


def numbered(df: DataFrame, *by: Column | str, name: str = "place") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of ``by``.  Rows are range-partitioned and sorted, then each partition's
    rows are shifted by the number of rows before it: a table of one row per partition is all that one task ever sees.  A
    key with many rows is split over partitions as long as ``by`` tells its rows apart.

    Defined cases: nulls come first; rows equal in ``by`` get places in any order; an empty table stays empty."""
    rows = save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW))).alias(name))


def running(df: DataFrame, value: Column, *by: Column | str, name: str = "total") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows up to and with this one in the order of ``by``.  As numbered():
    sums of whole partitions first, then each partition's own running sum from there.

    Defined cases: a null value adds nothing; rows equal in ``by`` are taken in any order; an empty table stays empty."""
    rows = save(df.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "running")
    part = F.shiftright("_at", 33).alias("_part")
    sums = rows.groupBy(part).agg(F.sum("_v").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy("_at"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + own).alias(name))
