"""Numbers from 0 for the rows of a table in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.shared import even_partitions, written

#: Rows that a range of the order should hold.
RANGE_ROWS = 250_000
_IN_PARTITION = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[Column], name: str, rank: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` with their place in `order` as column `rank`. Give a written table and an order without ties.

    Rows are dealt by range and numbered within each range; only one row count for each range meets in one task. A key that
    many rows share is split like any other, as `order` tells its rows apart.
    """
    parts = even_partitions(rows.count(), range_rows)
    held = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = held.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = held.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range")
    return numbered.withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))).drop("_at", "_range", "_start")
