"""Order-dependent operators that never put a huge group into one task.

Rows are dealt by range of (key, order) and written once, so a large group lies in as many
partitions as it needs and the input is evaluated once.  Inside a partition a window runs per
key; what came before is a carry.  Only the first key of a partition can go on from an earlier
one, so there are at most as many carries as partitions, whatever the number of keys, and they
are broadcast.  Groups of all sizes take the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import Rounds


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in order by range, written, with ``__at`` (rising over all rows) and its partition ``__part``."""
    by = [F.col(c) for c in keys + order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return Rounds(df.sparkSession).keep(ranged).withColumn("__part", F.shiftright("__at", 33))


def _carried(dealt: DataFrame, keys: list[str], per: Column, carry: Column) -> DataFrame:
    """``dealt`` with ``__carry`` for the rows of each (partition, key) whose key has a part in another partition.

    ``per`` aggregates a part to ``__per``; ``carry`` is a window expression over a key's parts, null where there is none.
    """
    parts = dealt.groupBy("__part", *keys).agg(per.alias("__per"))
    parts = parts.withColumn("__carry", carry).filter("__carry IS NOT NULL")
    parts = F.broadcast(parts.select(*[F.col(c).alias("__r_" + c) for c in ["__part", *keys]], "__carry"))  # at most a row per partition
    same = reduce(lambda x, y: x & y, [dealt[c].eqNullSafe(parts["__r_" + c]) for c in ["__part", *keys]])
    return dealt.join(parts, same, "left").drop(*["__r_" + c for c in ["__part", *keys]])


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order`` (nulls first)."""
    dealt = _dealt(df.withColumn("__v", value), keys, order)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    rows = _carried(dealt, keys, F.sum("__v"), F.sum("__per").over(before))
    inner = F.sum("__v").over(Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(F.col("__carry").isNull(), inner).otherwise(F.col("__carry") + F.coalesce(inner, F.lit(0)))
    return rows.withColumn(out, total).drop("__v", "__carry", "__at", "__part")


def row_index(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position per key in ``order``."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out)


def previous_value(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, following: bool = False) -> DataFrame:
    """Neighbouring value per key: the one before, or after when ``following``."""
    shift, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    held = F.struct(F.col(column).alias("v"))
    near = shift("__per").over(Window.partitionBy(*keys).orderBy("__part"))
    rows = _carried(_dealt(df, keys, order), keys, edge(held, "__at"), near)
    here = shift(held).over(Window.partitionBy("__part", *keys).orderBy("__at"))
    return rows.withColumn(out, F.coalesce(here, F.col("__carry")).getField("v")).drop("__carry", "__at", "__part")


def global_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based position in the order of all rows: rows are dealt by range and written, so that a row's position
    in its partition is known; partitions get their offsets from a table with a row each."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = Rounds(df.sparkSession).keep(ranged).withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(offsets, "__part").select(*df.columns, place.cast("bigint").alias(out))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    body = F.struct(*lead, *[c for c in rest if c not in lead])
    return df.groupBy(*keys).agg(F.min(body).alias("__first")).select(*keys, "__first.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key; Spark prunes to k per task before the shuffle."""
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= k
    )
    return out if rank else out.drop(name)


def first_then_cap(
    df: DataFrame, group: list[str], dedupe: list[str], order: list[str], n: int
) -> DataFrame:
    """Keep the first row per (group, dedupe key), then the first ``n`` rows per group."""
    kept = first_per_key(df, group + dedupe, order)
    return top_per_key(kept, group, [F.col(c) for c in order], n)
