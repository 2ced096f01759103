"""Session set-up and the shared-folder materialisation used by iterative jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("estatelens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or the session's warehouse where that is unset.

    Executors write and read these tables, so both are folders that a cluster shares.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return shared.rstrip("/") + "/estatelens"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table written by :func:`materialize`."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have the shuffle files of the queries run inside deleted as each ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Written:
    """A DataFrame backed by a written table, with its row count and the rows that met a condition."""

    def __init__(self, df: DataFrame, path: str, rows: int, hits: int = 0):
        self.df, self.path, self.rows, self.hits = df, path, rows, hits

    def drop(self) -> None:
        drop_table(self.df.sparkSession, self.path)


def materialize(df: DataFrame, tag: str = "stage", where: Column | None = None) -> Written:
    """Write ``df`` once and read it back.

    This cuts the lineage of iterative jobs and counts the rows in the same job. A written table survives the loss of any executor,
    and its true size lets the next round pick the right join.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    hits = F.count_if(F.lit(False) if where is None else where).alias("hits")
    with released_shuffles(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), hits).write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), path, seen.get["rows"], seen.get["hits"])


def global_index(df: DataFrame, *order: str, name: str = "idx", within: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of each row under a total order, without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its rows, and the offsets come
    from per-partition counts (one row per partition, so broadcasting them is bounded). Columns in
    ``within`` end the order but draw no partition boundaries, so their values are not sampled.
    """
    numbered = materialize(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order, *within)
        .withColumn("_m", F.monotonically_increasing_id()),
        "index",
    ).df
    part, pos = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("_p", part).withColumn("_i", pos).drop("_m")
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_p",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_o"),
    )
    return (
        numbered.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_o") + F.col("_i"))
        .drop("_p", "_i", "_o")
    )
