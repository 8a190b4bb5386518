"""Positions of rows within their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import kept


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (from 0, nulls first) and ``n``, the position and the number of rows with equal, non-null ``keys``.

    Rows are dealt by range of keys and order and written, so a large group lies in many partitions; a row
    knows its place in its partition, and a table of a row per group and partition tells what came before.
    """
    by = [F.col(c).asc_nulls_first() for c in keys + order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = kept(dealt, "ranked").withColumn("__part", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*keys)
    before = F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", *keys, "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(group).alias("n"))
    found = dealt.join(offsets, ["__part", *keys])
    return found.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"), "n")
