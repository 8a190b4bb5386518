"""Query registry: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def template(text: str) -> str:
    """SQL text expression for ``text`` with ``<<expr>>`` holes, valid in Spark and ANSI engines."""
    out = []
    for i, part in enumerate(re.split(r"<<(.+?)>>", text, flags=re.S)):
        if i % 2:
            out.append(f"CAST({part} AS STRING)")
            continue
        for seg in re.split(r"([{}\n'\\])", part):
            if not seg:
                continue
            out.append(f"chr({ord(seg)})" if seg in "{}\n'\\" else f"'{seg}'")
    return "(" + " || ".join(out) + ")"


def view(name: str, sql: str) -> None:
    """Register a derived table; ``{table}`` names a shared table, ``$view`` another view."""
    VIEWS[name] = sql


def _expand(sql: str) -> str:
    while True:
        new = re.sub(r"\$([a-z_]+)\b", lambda m: "(" + VIEWS[m.group(1)] + ")", sql)
        if new == sql:
            return sql
        sql = new


class Tables:
    """The shared tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        # plans, not data: the same lazy frame serves every use within one query
        self._plans: dict[tuple, DataFrame] = {}

    def _plan(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._plans:
            self._plans[key] = make()
        return self._plans[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._plan(("table", name), lambda: self.spark.read.parquet(f"{self.root}/{name}.parquet"))
        raise AttributeError(name)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that one query writes and then reads several times."""
        return self._plan(("kept", name), make)

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy row work: an input of a few splits is dealt out to the cores.

        An input with many splits, the normal case on a cluster, is left as it is.
        """
        want = min(self.spark.sparkContext.defaultParallelism, 32)

        def deal() -> DataFrame:
            df = getattr(self, name)
            return df if 2 * df.rdd.getNumPartitions() > want else df.repartition(want)

        return self._plan(("spread", name), deal)

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        text = _expand(text)
        read = self.spread if spread else lambda n: getattr(self, n)
        used = {n: read(n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)

    def view(self, name: str, spread: bool = False) -> DataFrame:
        return self._plan(("view", name, spread), lambda: self.sql(VIEWS[name], spread))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its optional check SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = re.sub(
                r"\{(" + "|".join(TABLES) + r")\}", lambda m: m.group(1), _expand(sql)
            )
        return fn

    return wrap
