"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows: what a task holds as Python values stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices(texts: Iterable, most: int = 1 << 20) -> Iterator[list]:
    """Runs of whole values (texts or lists) with about ``most`` elements each, so that a task never works on much at once."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text.values) if isinstance(text, pa.ListScalar) else len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """``(doc_id, text, label, place)``: texts with a label 0 or 1 to learn from, at most ``most`` of them.

    ``learn`` says which rows may be learned from.  Where more are there, those whose hashed id is least
    make the sample; ``place`` is that hash.  A repeated id gives one text (the least), contradicting
    labels of an id both count.
    """
    place = F.xxhash64("doc_id").alias("place")
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & learn)
    rows = rows.select("doc_id", F.col(column).cast("int").alias("label"), place).distinct()
    rows = rows.orderBy("place", "doc_id", "label").limit(most)
    texts = docs.select("doc_id", whole(F.col("text")).alias("text"))
    # at most ``most`` short rows
    return texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))


def filtered(docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose texts pass ``make()(texts)``, with all their columns; map-only."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for b in small(batches):
            yield b.filter(pa.array(passes([t or "" for t in b.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, schema)
