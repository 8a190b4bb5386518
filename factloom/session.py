"""Session helpers: local test session and durable (written) intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session,
    where driver and executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Rounds:
    """Written tables for an iterative job.

    ``keep(df)`` writes a round to the shared folder and returns it read back, which cuts
    the lineage, survives lost executors and gives the optimizer true sizes.  Rounds older
    than the previous one are deleted as the job moves on.
    """

    def __init__(self, spark: SparkSession, depth: int = 2):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.depth = depth
        self._paths: dict[str, list[str]] = {}
        self.seen: dict = {}
        self._n = 0

    def keep(self, df: DataFrame, slot: str = "r", watch: dict[str, Column] | None = None) -> DataFrame:
        """Write a round.  Aggregates in ``watch`` are taken while it is written and left in
        ``seen``, so a convergence test costs no job of its own."""
        path = f"{self.root}/{slot}-{self._n}"
        self._n += 1
        schema = df.schema
        if watch:
            seen = Observation()
            df = df.observe(seen, *[c.alias(n) for n, c in watch.items()])
        df.write.mode("overwrite").parquet(path)
        if watch:
            self.seen = seen.get
        paths = self._paths.setdefault(slot, [])
        paths.append(path)
        while len(paths) > self.depth:
            self._delete(paths.pop(0))
        return self.spark.read.schema(schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)
