"""Structured Streaming jobs over the analysis and change feeds.

Every job takes a streaming DataFrame (or a batch one where noted) and returns one, or starts a
query with a sink. State is keyed by repository and path; watermarks bound it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rating as R
from ..operators import merge as MG
from ..operators import risk as RK
from ..operators.windows import previous_row, rating_deltas
from ..schemas import PUSH_PAYLOAD
from ..sinks import store as ST


def read_feed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 64) -> DataFrame:
    """Parquet files of a landing folder as a stream with a fixed schema."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def upsert_feed(analyses: DataFrame, table: str, history: str, checkpoint: str, delta: str | None = None):
    """Analysis feed: upsert the latest state, append the history, and write the changed rows.

    The history is written under the batch id, so a batch that runs again replaces its own rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest = ST.latest_by_key(batch, ["repo", "path"], ["analyzedAt", "seq"]).select(*batch.columns)
        ST.write_upsert(latest, table)
        _write_batch(ST.history_rows(batch), batch_id, history)
        if delta:
            _write_batch(latest, batch_id, delta)

    return analyses.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_feed(analyses: DataFrame, gates: DataFrame, default: float = 6.5) -> DataFrame:
    """Failing analyses with the gate they missed; ``gates``: (repo, min_rating), a static table."""
    joined = analyses.join(gates.select("repo", "min_rating"), "repo", "left")
    minimum = F.coalesce("min_rating", F.lit(default))
    return joined.withColumn("min_rating", minimum).filter(F.col("rating") < F.col("min_rating"))


def change_batches(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Debounced change batches per repository: a quiet gap closes a batch.

    The streaming form keeps one open session per repository with counts and times, not rows. The
    batch form finds the batch starts by time buckets, so a busy repository is not one task.
    """
    totals = (F.count(F.lit(1)).alias("changes"), F.max("ts").alias("last_ts"))
    if changes.isStreaming:
        w = F.session_window("ts", gap).alias("w")
        out = changes.withWatermark("ts", late).groupBy(w, "repo").agg(F.min("ts").alias("first_ts"), *totals)
    else:
        out = _batch_starts(changes, gap).groupBy("repo", "first_ts").agg(*totals)
    return out.select("repo", "first_ts", "last_ts", "changes")


def _batch_starts(changes: DataFrame, gap: str, bucket: str = "1 hour") -> DataFrame:
    """Changes with the first time of their debounced batch.

    A batch starts where the gap to the change before it is long enough; every change belongs to
    the latest start. Starts are carried forward from bucket to bucket.
    """
    p = previous_row(changes, ["repo"], "ts", "seq", ["ts"], bucket)
    opens = F.col("prev").isNull() | (F.col("ts") >= F.col("prev.ts") + F.expr(f"INTERVAL {gap}"))
    p = p.withColumn("_s", F.when(opens, F.col("ts"))).withColumn("_b", F.window(F.col("ts").cast("timestamp"), bucket)["start"])
    so_far = Window.partitionBy("repo", "_b").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("repo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = p.groupBy("repo", "_b").agg(F.max("_s").alias("_m")).select("repo", "_b", F.max("_m").over(earlier).alias("_c"))
    first = F.coalesce(F.max("_s").over(so_far), F.col("_c")).alias("first_ts")
    return p.join(carried, ["repo", "_b"]).select("repo", "path", "ts", "seq", first)


def batch_members(changes: DataFrame, gap: str) -> DataFrame:
    """Distinct paths of each debounced batch as rows (repo, first_ts, path), from a table of changes."""
    return _batch_starts(changes, gap).select("repo", "first_ts", "path").distinct()


def detect_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Batch form of change detection: new, modified or deleted between two listings (path, mtime)."""
    b = before.select("path", F.col("mtime").alias("m0"))
    a = after.select("path", F.col("mtime").alias("m1"))
    kind = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "deleted").when(F.col("m0") != F.col("m1"), "modified")
    return a.join(b, "path", "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL").select("path", "kind")


def change_sequence(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """New, modified or deleted for each sighting of a path (path, mtime, kind, ts, seq), in time order."""
    out = previous_row(events, ["path"], "ts", "seq", ["kind", "mtime"], bucket)
    known = F.coalesce(F.col("prev.kind") != "deleted", F.lit(False))
    gone = F.col("kind") == "deleted"
    kind = F.when(gone & known, "deleted").when(~gone & ~known, "new").when(~gone & (F.col("mtime") != F.col("prev.mtime")), "modified")
    return out.withColumn("kind", kind).filter("kind IS NOT NULL").drop("prev")


def _write_batch(rows: DataFrame, batch_id: int, target: str) -> None:
    """Write rows under their batch id: a batch that runs again replaces its own rows only."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(target)


def graph_deltas(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and incident edges of each changed file, as rows (path, kind, source, target, rating)."""
    n = changed.join(nodes.select(F.col("id").alias("path"), "rating"), "path").select(
        "path", F.lit("node").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "rating"
    )
    both = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("path"), "source", "target")
    e = changed.join(both, "path").select("path", F.lit("edge").alias("kind"), "source", "target", F.lit(None).cast("double").alias("rating"))
    return n.unionByName(e)


def first_sessions(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each session once, at its first event; with ``late`` the state is bounded by a watermark."""
    if not events.isStreaming:
        return events.groupBy("session_id").agg(F.min("ts").alias("ts"))
    if late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id"])
    return events.dropDuplicates(["session_id"])


def scan_progress(analysed: DataFrame, step: int = 50) -> DataFrame:
    """Running count per scan, with the number of whole steps reached."""
    return analysed.groupBy("scan_id").agg(F.count(F.lit(1)).alias("analyzed")).withColumn("steps", F.floor(F.col("analyzed") / step))


def low_rating_alerts(analyses: DataFrame, below: float = 5.0, bucket: str = "1 hour") -> DataFrame:
    """First moment the mean of a repository's current ratings falls below the limit.

    Input is the history (repo, path, rating, recorded_at, seq). Each row changes the repository's
    sum by the difference to the file's previous rating, so the mean is a running sum. Running
    sums are built from per-bucket totals, so one busy repository is not one task's window.
    """
    d = rating_deltas(analyses, bucket)
    step = d.withColumn("_add", F.round((F.col("rating") - F.coalesce("previous", F.lit(0.0))) * 10).cast("long")).withColumn(
        "_new", F.when(F.col("previous").isNull(), 1).otherwise(0)
    )
    step = step.withColumn("_b", F.window(F.col("recorded_at").cast("timestamp"), bucket)["start"])
    inside = Window.partitionBy("repo", "_b").orderBy("recorded_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = step.withColumn("_s", F.sum("_add").over(inside)).withColumn("_n", F.sum("_new").over(inside))
    per = step.groupBy("repo", "_b").agg(F.sum("_add").alias("bs"), F.sum("_new").alias("bn"))
    before = Window.partitionBy("repo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("repo", "_b", F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    mean = R.round1((F.col("_s") + F.col("s0")) / 10 / (F.col("_n") + F.col("n0")))
    low = run.join(base, ["repo", "_b"]).withColumn("overall", mean).filter(F.col("overall") < below)
    return low.groupBy("repo").agg(F.min(F.struct("recorded_at", "seq", "overall")).alias("f")).select(
        "repo", F.col("f.recorded_at").alias("recorded_at"), F.col("f.seq").alias("seq"), F.col("f.overall").alias("overall")
    )


def latest_items(feed: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Latest state per item; run in update or complete mode."""
    cols = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def rating_windows(history: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Mean rating and analyses per repository and time window (tumbling, or sliding with ``slide``)."""
    events = history.withWatermark("recorded_at", late) if history.isStreaming else history
    window = F.window("recorded_at", size, slide) if slide else F.window("recorded_at", size)
    # Whole tenths make the sum independent of arrival order.
    tenths = F.sum(F.round(F.col("rating") * 10).cast("long"))
    return (
        events.groupBy(window.alias("w"), "repo")
        .agg(F.count(F.lit(1)).alias("analyses"), tenths.alias("tenths"))
        .select("repo", F.col("w.start").alias("window_start"), "analyses", R.round1(F.col("tenths") / 10 / F.col("analyses")).alias("overall_rating"))
    )


def push_feed(payloads: DataFrame, edges: DataFrame, nodes: DataFrame, target: str, checkpoint: str):
    """Push events: changed files, their graph context and the comment verdict of each push."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(push_verdicts(batch, edges, nodes), batch_id, target)

    return payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_verdicts(payloads: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verdict per push; ``payloads``: (push_id, payload JSON)."""
    p = payloads.withColumn("p", F.from_json("payload", PUSH_PAYLOAD)).select("push_id", F.explode("p.commits").alias("c"))
    files = MG.changed_files(p.select("push_id", "c.added", "c.modified"))
    summaries = RK.push_summaries(files, edges, nodes)
    return RK.comment_verdicts(files.join(summaries, "file"), "push_id")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        q.trigger(availableNow=True).start().awaitTermination()
    else:

        def handle(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(target)

        q = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


