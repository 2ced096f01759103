"""Maintenance of the stored tables: upserts, history, deletes and repository rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. An aggregate: a key with very many versions combines map-side."""
    cols = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, keys=("repo", "path"), order=("analyzedAt", "seq")) -> DataFrame:
    """Last write wins by key; an older ``order`` value never replaces a newer one."""
    return latest_by_key(old.unionByName(new), list(keys), list(order)).select(*old.columns)


#: Buckets of each partition of a stored table; a write touches only the buckets of its keys.
BUCKETS = 16


def write_upsert(
    new: DataFrame, target: str, partition: str = "repo", keys=("repo", "path"), order=("analyzedAt", "seq"), buckets: int = BUCKETS
) -> None:
    """Upsert into a Parquet table partitioned by ``partition`` and a hash ``bucket`` of the other keys.

    Only the buckets that hold a key of ``new`` are read and rewritten, so a repository of any size costs one bucket
    for one changed file. The same batch written again leaves the same table. ``buckets`` stays the same for a table.
    """
    spark, parts = new.sparkSession, [partition, "bucket"]
    inner = [k for k in keys if k != partition] or list(keys)
    bucket = F.pmod(F.xxhash64(*inner), F.lit(buckets)).cast("int")
    batch = materialize(new.withColumn("bucket", bucket), "batch")
    cols, merged = batch.df.columns, None
    if _exists(spark, target):
        # The comparison makes the touched buckets a filter by which the scan of the table is pruned at run time.
        touched = batch.df.filter(F.col("bucket") < buckets).select(*parts).distinct()
        old = spark.read.schema(batch.df.schema).parquet(target).join(touched, parts, "left_semi").select(*cols)
        merged = materialize(upsert(old, batch.df, keys, order), "merged")
    rows = merged.df if merged else latest_by_key(batch.df, list(keys), list(order)).select(*cols)
    (
        rows.repartition(*parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(target)
    )
    batch.drop()
    if merged:
        merged.drop()


def _exists(spark, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def history_rows(analyses: DataFrame) -> DataFrame:
    return analyses.select("repo", "path", "rating", F.col("analyzedAt").alias("recorded_at"), "seq")


def append_history(analyses: DataFrame, target: str) -> None:
    history_rows(analyses).write.mode("append").parquet(target)


def delete_rows(table: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows left after a delete, and how many rows each key removed."""
    k = keys.select(*on).distinct()
    removed = table.join(k, on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("removed"))
    return table.join(k, on, "left_anti"), removed


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, on: list[str]) -> dict[str, DataFrame]:
    """Apply one delete to several tables (analyses, history)."""
    return {name: delete_rows(t, keys, on)[0] for name, t in tables.items()}


# Columns a second registration may change; all others keep their first value.
MUTABLE_REPO_COLUMNS = ("name", "session_id", "session_type", "is_active")


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update repository rows, keeping creation time and statistics."""
    n = new.select(F.col("id"), *[F.col(c).alias(f"n_{c}") for c in new.columns if c != "id"], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, "id", "full_outer")
    pick = lambda c: (
        F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c))
        if c in MUTABLE_REPO_COLUMNS
        else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"n_{c}"))
    )
    return both.select("id", *[pick(c).alias(c) for c in old.columns if c != "id"])


def update_repo_stats(repos: DataFrame, stats: DataFrame, analyzed_at) -> DataFrame:
    """Set file count, rating and time of the repositories in ``stats`` (repo, file_count, overall_rating)."""
    s = stats.select(F.col("repo").alias("path"), F.col("file_count").alias("_n"), F.col("overall_rating").alias("_r"))
    hit = F.col("_n").isNotNull()
    return (
        repos.join(s, "path", "left")
        .withColumn("file_count", F.when(hit, F.col("_n")).otherwise(F.col("file_count")))
        .withColumn("overall_rating", F.when(hit, F.col("_r")).otherwise(F.col("overall_rating")))
        .withColumn("last_analyzed", F.when(hit, analyzed_at).otherwise(F.col("last_analyzed")))
        .select(*repos.columns)
    )
