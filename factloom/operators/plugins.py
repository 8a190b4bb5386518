"""User extractors: a function ``(path, text) -> rows`` or a set of text rules, by name."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import Rule, rule_facts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT_SCHEMA = "path string, line bigint, kind string, prop string, value string"


@dataclass(frozen=True)
class Extractor:
    """``fn`` yields ``(line, kind, prop, value)``; ``pattern`` is the regex of paths it wants."""

    name: str
    pattern: str
    fn: Callable[[str, str], Iterable[tuple]] | None = None
    rules: tuple[Rule, ...] = field(default=())


def select_extractors(known: list[Extractor], include: list[str] | None = None, exclude: list[str] | None = None) -> list[Extractor]:
    """Extractors named in ``include`` (all when empty) and not in ``exclude``."""
    return [x for x in known if (not include or x.name in include) and x.name not in (exclude or [])]


def _run(fn: Callable[[str, str], Iterable[tuple]]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, text in zip(pdf["path"], pdf["text"]) for r in fn(p, text or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "prop", "value"])

    return work


def run_extractors(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Facts of all extractors over ``files(path, text)``; a failing file ends the job loudly.

    Rule sets stay inside the JVM; functions see Arrow batches of the paths they asked for.
    """
    out = None
    for x in extractors:
        wanted = files.filter(F.col("path").rlike(x.pattern)).select("path", "text")
        facts = wanted.mapInPandas(_run(x.fn), FACT_SCHEMA) if x.fn else rule_facts(wanted, x.rules).select("path", "line", "kind", "prop", "value")
        facts = facts.withColumn("extractor", F.lit(x.name))
        out = facts if out is None else out.unionByName(facts)
    if out is None:
        raise ValueError("no extractor selected")
    return out
