"""Equi-joins whose one side may hold a large share of its rows under one key.

A key is hot if it holds more than one in ``SHARE`` rows and more than ``SLOT``.  By that rule fewer than
``SHARE`` keys can be hot, whatever the size of the table, so their list is small enough for the driver and to
broadcast.  A hot key's rows are dealt over slots, none much above that size, and its one row on the other
side is repeated once per slot.  Where no key is hot it is a plain join.  ``by_group`` parts hot groups from the others
for jobs that would take a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, SLOT = 10_000, 128


def hot_keys(sizes: DataFrame, key: str, total: int) -> DataFrame | None:
    """``(key, slots)`` of the hot keys of ``sizes(key, n)``, None where there are none.

    ``total`` is the sum of n, or a bound above it.
    """
    if total <= SLOT:
        return None
    most = max(SLOT, total / SHARE)
    found = sizes.filter(F.col(key).isNotNull() & (F.col("n") > most)).select(key, F.ceil(F.col("n") / most).cast("long").alias("slots"))
    rows = found.collect()  # fewer than SHARE, as n sums to at most ``total``
    return sizes.sparkSession.createDataFrame(rows, found.schema) if rows else None


#: Rows that one task holds of groups dealt by key, and rows of a group that is never hot.
TASK_ROWS, GROUP = 200_000, 10_000
#: Counters of hashed keys; a key is counted for itself only where a counter holds more rows than a hot key.
COUNTERS = 1 << 16


def by_group(
    tables: list[DataFrame], key: str, near: Callable[[list[DataFrame], int], DataFrame], far: Callable[[list[DataFrame]], DataFrame], sized: list[int] | None = None
) -> DataFrame:
    """A job on the groups of ``key``: ``near(tables, tasks)`` for those whose rows fit one task, ``far(tables)`` for hot ones.

    The rows of the tables ``sized`` (all, if not given) are counted by hashed key, in one pass over that column; ``tasks``
    grows with them.  Null is a key like others.
    """
    spark, some = tables[0].sparkSession, [tables[i].select(key) for i in (sized or range(len(tables)))]
    keys = reduce(DataFrame.unionByName, some)
    counters = keys.groupBy(F.pmod(F.xxhash64(key), F.lit(COUNTERS)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    seen = counters.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    total = seen["total"] or 0
    tasks, most = max(spark.sparkContext.defaultParallelism, total // TASK_ROWS + 1), max(GROUP, total / SHARE)
    if (seen["most"] or 0) <= most:
        return near(tables, tasks)
    found = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col(key).alias("__hot"))
    rows = found.collect()  # fewer than SHARE
    if not rows:
        return near(tables, tasks)
    few = F.broadcast(spark.createDataFrame(rows, found.schema))
    pick = lambda how: [t.join(few, t[key].eqNullSafe(few["__hot"]), how) for t in tables]
    return near(pick("left_anti"), tasks).unionByName(far(pick("left_semi")))


def split_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key``; ``hot`` comes from ``hot_keys``.

    ``by`` are columns that tell the rows of one key apart; their hash picks the slot, so a task that runs
    again deals them alike.  Null keys meet nothing.
    """
    if hot is None:
        return rows.join(table, key)
    marks = F.broadcast(hot.select(key, F.col("slots").alias("__slots")))
    count = F.coalesce("__slots", F.lit(1).cast("long"))
    left = rows.join(marks, key, "left").withColumn("__slot", F.pmod(F.xxhash64(*by), count)).drop("__slots")
    right = table.join(marks, key, "left").withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("__slots")
    return left.join(right, [key, "__slot"]).drop("__slot")
