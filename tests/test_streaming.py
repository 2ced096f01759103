"""Event-time behaviour of the feeds, with controlled batches."""

from datetime import datetime, timedelta

from estatelens.streaming import jobs as J
from estatelens.streaming import stateful as S
from pyspark.sql import functions as F

SCHEMA = "repo string, path string, rating double, recorded_at timestamp, seq long"


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    day = lambda n: start + timedelta(days=n)
    feed, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))

    def send(*rows):
        spark.createDataFrame([("r", f"f{seq}", rating, at, seq) for seq, rating, at in rows], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = J.rating_windows(spark.readStream.schema(SCHEMA).parquet(feed))
        got = J.run_to_table(stream, out, state).collect()
        return {r.window_start.date().isoformat(): (r.analyses, r.overall_rating) for r in got}

    assert send((1, 4.0, day(0)), (2, 6.0, day(0)), (3, 9.0, day(5)))["2024-01-01"] == (2, 5.0)
    # The watermark stands at day 4: the row of day 0 is late, the one of day 5 is not.
    got = send((4, 0.0, day(0)), (5, 7.0, day(5)), (6, 8.0, day(9)))
    assert got["2024-01-01"] == (2, 5.0) and got["2024-01-06"] == (2, 8.0)
    assert "2024-01-10" not in got


CHANGE = "repo string, path string, mtime timestamp, kind string, ts timestamp, seq long, rating double, recorded_at timestamp"
NOON = datetime(2024, 1, 1, 12)


class Feed:
    """Lands rows file by file; every call of ``run`` is a restart of the job from its checkpoint."""

    def __init__(self, spark, folder, job):
        self.spark, self.folder, self.job = spark, str(folder), job

    def run(self, *rows):
        at = lambda s: NOON + timedelta(seconds=s)
        rows = [(repo, path, at(s if mtime is None else mtime), kind, at(s), seq, rating, at(s)) for s, repo, path, kind, seq, rating, mtime in rows]
        self.spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(f"{self.folder}/feed")
        stream = self.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/feed")
        S.run_feed(self.job(stream), f"{self.folder}/out", f"{self.folder}/checkpoint")
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()), key=str)


def change(s, path, seq, kind="modified", repo="r", rating=9.0, mtime=None):
    return s, repo, path, kind, seq, rating, mtime


def test_change_detection_keeps_state_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, S.detect_changes)
    first = [("a", "new", 1), ("b", "new", 2), ("a", "modified", 3)]
    assert feed.run(change(0, "a", 1, "new"), change(1, "b", 2), change(2, "a", 3)) == sorted(first)
    # The same time of change again is no change; a late sighting is passed over; a deleted path is new again.
    second = [("a", "deleted", 6), ("a", "new", 8)]
    got = feed.run(change(4, "a", 5, mtime=2), change(5, "a", 6, "deleted"), change(6, "a", 7, "deleted"), change(7, "a", 8, mtime=2), change(0, "b", 0, mtime=99))
    assert got == sorted(first + second)


def test_untouched_keys_are_not_written_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, S.detect_changes)
    feed.run(*[change(k, f"f{k}", k, "new") for k in range(200)])
    rows = [("r", "f3", NOON + timedelta(hours=1), "modified", NOON + timedelta(hours=1), 500, 1.0, NOON)]
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(f"{feed.folder}/feed")
    stream = spark.readStream.schema(CHANGE).parquet(f"{feed.folder}/feed")
    with S.state_store(spark):
        q = S.detect_changes(stream).writeStream.outputMode("append").format("parquet").option("path", f"{feed.folder}/out")
        q = q.option("checkpointLocation", f"{feed.folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    state = [s for p in q.recentProgress for s in p["stateOperators"] if p["numInputRows"]]
    assert sum(s["numRowsUpdated"] for s in state) == 1 and state[0]["numRowsTotal"] == 200


def test_batches_close_after_a_quiet_gap_with_their_paths(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda d: S.debounced_paths(d, "10 seconds", "0 seconds", 3))
    assert feed.run(change(0, "a", 1), change(5, "b", 2), change(20, "a", 3), change(21, "z", 4, repo="q")) == []
    at = lambda s: NOON + timedelta(seconds=s)
    first = [("r", at(0), at(5), 2, "a"), ("r", at(0), at(5), 2, "b"), ("q", at(21), at(21), 1, "z")]
    # 26 prolongs the batch that began at 20; at 45 the one of q is over.
    assert feed.run(change(26, "c", 5), change(45, "y", 6, repo="q")) == sorted(first, key=str)
    later = [("r", at(20), at(26), 2, "a"), ("r", at(20), at(26), 2, "c"), ("q", at(45), at(45), 1, "y")]
    assert feed.run(change(500, "h", 7, repo="x")) == sorted(first + later, key=str)


def test_each_scan_step_is_told_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda d: S.scan_steps(d.select(F.col("repo").alias("scan_id"), F.when(F.col("repo") == "r", 7).alias("total")), 3))
    assert feed.run(*[change(k, f"f{k}", k) for k in range(2)]) == []
    assert feed.run(*[change(k, f"f{k}", k) for k in range(2, 6)], change(9, "x", 9, repo="q")) == [("r", 1, 3), ("r", 2, 6)]
    assert feed.run(change(10, "f6", 10), *[change(11 + k, f"x{k}", 11 + k, repo="q") for k in range(3)]) == [("q", 1, 3), ("r", 1, 3), ("r", 2, 6), ("r", 3, 7)]


def test_alerts_are_told_once_per_repository(spark, tmp_path):
    feed = Feed(spark, tmp_path, S.low_rating_alerts)
    at = lambda s: NOON + timedelta(seconds=s)
    assert feed.run(change(0, "a", 1, rating=9.0), change(1, "b", 2, rating=4.0)) == []
    told = [("r", at(2), 3, 3.0)]
    assert feed.run(change(2, "a", 3, rating=2.0), change(3, "z", 4, repo="q", rating=8.0)) == told
    assert feed.run(change(4, "a", 5, rating=9.9), change(5, "a", 6, rating=0.0)) == told
    assert feed.run(change(6, "z", 7, repo="q", rating=1.0)) == [("q", at(6), 7, 1.0), *told]
