"""Structured Streaming forms: unseen content, change feed and rolling counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.joins import snapshot_diff


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder (or glob) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unseen_content(files: DataFrame, extractor: str, version: str = "1") -> DataFrame:
    """Each (extractor, version, content hash) once."""
    keyed = files.withColumn("extractor", F.lit(extractor)).withColumn("version", F.lit(version)).withColumn("sha", F.sha2("text", 256))
    return keyed.dropDuplicates(["extractor", "version", "sha"])


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per key and window; ``late`` sets the watermark of a stream."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions per key.  Set ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` in the session, as
    ``local_session`` does: sessions of a hot key are then merged in every task before the shuffle."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that has arrived, then stop."""
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_complete(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run an aggregating stream over everything that has arrived; each batch replaces the whole result."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def change_feed(key: str, versions: str, feed: str, tombstone: str | None = None) -> Callable:
    """Start a feed of snapshot changes: each batch is compared with the version before it.

    A batch holds the latest rows of the keys that it touches; where the boolean column ``tombstone`` is
    true the key is gone from then on.  A version and its changes are written under the batch's number, so a
    batch that is run again after a failure replaces its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "version").alias("s")).select(key, "s.*").drop("version")
        touched = latest.select(key)
        if tombstone:
            latest = latest.filter(~F.coalesce(tombstone, F.lit(False))).drop(tombstone)
        if number:
            old = spark.read.parquet(f"{versions}/{number - 1}")
            now = old.join(touched, key, "left_anti").unionByName(latest)
        else:
            old, now = latest.limit(0), latest
        now.write.mode("overwrite").parquet(f"{versions}/{number}")
        written = spark.read.parquet(f"{versions}/{number}")
        changes = snapshot_diff(old, written, key).withColumn("batch", F.lit(number))
        changes.write.mode("overwrite").parquet(f"{feed}/batch={number}")

    return step


