"""Jobs with keyed state: change detection, debounced batches, scan steps and one-time alerts.

State lives in the state store, a value or a map entry per key, so that a trigger writes only the keys it touched and a
restart goes on from the last checkpoint. Rows of one key are ordered by time inside a trigger; a row that is not newer
than what its key remembers counts as late and is passed over. The processors see one key at a time, so every job spreads
a busy repository over further keys, or brings only numbers to its one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Keys over which the paths of one repository's batches are spread.
SHARDS = 16
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that these jobs need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All rows of a key in this trigger, by time."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


class _Detector(StatefulProcessor):
    """Remembers the last sighting of a path."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "mtime long, ts long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        mtime, seen = None, None
        if self.last.exists():
            mtime, *seen = self.last.get()
            seen = tuple(seen)
        before, out = seen, []
        for r in _ordered(rows, "ts", "seq").itertuples(index=False):
            if seen is not None and (r.ts, r.seq) <= seen:
                continue
            seen = (r.ts, r.seq)
            if r.kind == "deleted":
                kind, now = ("deleted" if mtime is not None else None), None
            else:
                kind, now = ("new" if mtime is None else "modified" if r.mtime != mtime else None), r.mtime
            mtime = now
            if kind:
                out.append((*key, kind, r.seq))
        if mtime is None:
            self.last.clear()  # a path that is gone leaves the state
        elif seen != before:
            self.last.update((int(mtime), int(seen[0]), int(seen[1])))
        if out:
            yield pd.DataFrame(out, columns=["path", "kind", "seq"])

    def close(self) -> None:
        pass


def detect_changes(sightings: DataFrame) -> DataFrame:
    """(path, kind, seq): new, modified or deleted for each sighting (path, mtime, kind, ts, seq) of a stream."""
    micros = sightings.select("path", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime"), "kind", F.unix_micros("ts").alias("ts"), "seq")
    return micros.groupBy("path").transformWithStateInPandas(_Detector(), "path string, kind string, seq long", "Append", "None")


class _Steps(StatefulProcessor):
    """Counts the files of a scan and tells each whole step once, and the end of a scan of known size."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "analyzed long")

    def handleInputRows(self, key, rows, timerValues):
        before = self.count.get()[0] if self.count.exists() else 0
        now, total = before, None
        for chunk in rows:
            now += len(chunk)
            known = chunk["total"].dropna()
            total = int(known.max()) if len(known) else total
        self.count.update((now,))
        told = [(*key, n, n * self.step) for n in range(before // self.step + 1, now // self.step + 1)]
        if total is not None and before < total <= now and total % self.step:
            told.append((*key, total // self.step + 1, total))
        if told:
            yield pd.DataFrame(told, columns=["scan_id", "step", "analyzed"])

    def close(self) -> None:
        pass


def scan_steps(analysed: DataFrame, step: int = 50) -> DataFrame:
    """(scan_id, step, analyzed): one row for each ``step`` files of a scan, and one as the scan is complete.

    Input is a stream of (scan_id) or (scan_id, total), a row per analysed file.
    """
    total = F.col("total").cast("long") if "total" in analysed.columns else F.lit(None).cast("long")
    rows = analysed.select("scan_id", total.alias("total"))
    return rows.groupBy("scan_id").transformWithStateInPandas(_Steps(step), "scan_id string, step long, analyzed long", "Append", "None")


class _Deltas(StatefulProcessor):
    """Change of a file's rating, in tenths, against the one before."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "tenths long, at long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        tenths, seen = None, None
        if self.last.exists():
            tenths, *seen = self.last.get()
            seen = tuple(seen)
        out = []
        for r in _ordered(rows, "at", "seq").itertuples(index=False):
            if seen is None or (r.at, r.seq) > seen:
                out.append((key[0], r.at, r.seq, r.tenths - (tenths or 0), int(tenths is None)))
                tenths, seen = r.tenths, (r.at, r.seq)
        if out:
            self.last.update((int(tenths), int(seen[0]), int(seen[1])))
            yield pd.DataFrame(out, columns=["repo", "at", "seq", "add", "new"])

    def close(self) -> None:
        pass


class _Latch(StatefulProcessor):
    """Running mean of a repository's current ratings; tells once that it fell below the limit."""

    def __init__(self, below: float):
        self.below = below

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "tenths long, files long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        tenths, files, told = self.total.get() if self.total.exists() else (0, 0, False)
        if told:
            return
        r = _ordered(rows, "at", "seq")
        sums, counts = tenths + r["add"].cumsum(), files + r["new"].cumsum()
        overall = (sums / 10 / counts * 10 + 0.5).floordiv(1) / 10
        low = overall.index[overall < self.below]
        self.total.update((int(sums.iloc[-1]), int(counts.iloc[-1]), len(low) > 0))
        if len(low):
            k = low[0]
            yield pd.DataFrame([(*key, r["at"][k], r["seq"][k], overall[k])], columns=["repo", "at", "seq", "overall"])

    def close(self) -> None:
        pass


def low_rating_alerts(history: DataFrame, below: float = 5.0) -> DataFrame:
    """(repo, recorded_at, seq, overall): the first time the mean of a repository's ratings falls below the limit, once.

    Input is a stream of (repo, path, rating, recorded_at, seq). Ratings are compared per file first, so that only
    differences reach the one key of a repository, which forgets the rows and keeps their sums.
    """
    rows = history.select("repo", "path", F.round(F.col("rating") * 10).cast("long").alias("tenths"), F.unix_micros("recorded_at").alias("at"), "seq")
    deltas = rows.groupBy("repo", "path").transformWithStateInPandas(_Deltas(), "repo string, at long, seq long, add long, new long", "Append", "None")
    told = deltas.groupBy("repo").transformWithStateInPandas(_Latch(below), "repo string, at long, seq long, overall double", "Append", "None")
    return told.select("repo", F.timestamp_micros("at").alias("recorded_at"), "seq", "overall")


class _Debounce(StatefulProcessor):
    """Gathers the paths of one shard of a repository's open batch; a quiet gap closes it.

    Rows are time slots no longer than the gap, each with its first and last change, so that a slot never spans two
    batches. Every shard sees all slots and its own paths.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, changes long")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def _told(self, key, batch, paths):
        """The batch with its paths of this shard; a shard without any stays silent."""
        if paths:
            yield pd.DataFrame([(*key, *batch, p) for p in sorted(paths)], columns=["repo", "shard", "first", "last", "changes", "path"])

    def _remembered(self) -> set[str]:
        return {p[0] for p in self.paths.keys()}

    def handleInputRows(self, key, rows, timerValues):
        r = pd.concat(list(rows), ignore_index=True)
        slots = r.groupby("slot", sort=True).agg(first=("first", "min"), last=("last", "max"), changes=("changes", "sum"))
        was = tuple(self.open.get()) if self.open.exists() else None
        if was:  # the open batch stands before all slots
            slots = pd.concat([pd.DataFrame([was], columns=["first", "last", "changes"], index=[-(1 << 62)]), slots])
        number = (slots["first"] >= slots["last"].cummax().shift() + self.gap).cumsum()
        batches = slots.groupby(number).agg(first=("first", "min"), last=("last", "max"), changes=("changes", "sum"))
        named = r[r["paths"].notna()]
        paths: dict[int, set[str]] = {}
        for k, p in zip(named["slot"].map(number), named["paths"], strict=True):
            paths.setdefault(k, set()).update(p)
        newest = len(batches) - 1
        for k in range(newest):
            own = paths.get(k, set()) | (self._remembered() if was and k == 0 else set())
            yield from self._told(key, tuple(int(x) for x in batches.iloc[k]), own)
        if was and newest:
            self.paths.clear()
        for p in paths.get(newest, ()):
            self.paths.updateValue((p,), (True,))
        batch = tuple(int(x) for x in batches.iloc[newest])
        self.open.update(batch)
        if was:
            self.handle.deleteTimer(self._due(was))
        self.handle.registerTimer(self._due(batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            yield from self._told(key, tuple(self.open.get()), self._remembered())
            self.paths.clear()
            self.open.clear()

    def _due(self, batch) -> int:
        """Milliseconds from which no slot that could prolong the batch is still to come."""
        return (batch[1] + 2 * self.gap) // 1000 + 1

    def close(self) -> None:
        pass


def debounced_paths(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """(repo, first_ts, last_ts, changes, path): the distinct paths of each batch of a stream, as a quiet gap closes it.

    Input is a stream of (repo, path, ts). Changes are first counted in slots of one gap per shard of paths; the slots
    reach all shards of their repository, the paths only their own.
    """
    micros = pd.Timedelta(gap).value // 1000
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    counted = (
        changes.withWatermark("ts", late)
        .groupBy(F.window("ts", gap).alias("w"), "repo", shard.alias("own"))
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("changes"), F.collect_set("path").alias("paths"))
    )
    spread = counted.select("w", "repo", "own", F.unix_micros("a").alias("first"), F.unix_micros("b").alias("last"), "changes", "paths", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    slots = spread.select(
        F.window_time("w").alias("at"), "repo", "shard", F.unix_micros("w.start").alias("slot"), "first", "last", "changes", F.when(F.col("own") == F.col("shard"), F.col("paths")).alias("paths")
    )
    out = slots.groupBy("repo", "shard").transformWithStateInPandas(_Debounce(micros), "repo string, shard int, first long, last long, changes long, path string", "Append", "EventTime")
    return out.select("repo", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "changes", "path")


def run_feed(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what a stateful stream gives for everything available, then stop."""
    with state_store(stream.sparkSession):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
