"""Vector expressions and the user embedding hook."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors get these functions with the task, whether or not the package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero-length vectors."""
    na = norm_a if norm_a is not None else F.sqrt(dot(a, a))
    nb = norm_b if norm_b is not None else F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(0.0)


def embedding_udf(embed: Callable[[list[str]], list[list[float]]], batch: int = 256):
    """Wrap a user's ``texts -> vectors`` function as an Arrow-batched column function."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                out.extend(embed(texts.iloc[i : i + batch].fillna("").tolist()))
            yield pd.Series(out)

    return run


def length_embedding(texts: list[str]) -> list[list[float]]:
    """A tiny embedding for tests and examples: text length and count of the letter e."""
    return [[float(len(x)), float(x.count("e"))] for x in texts]
