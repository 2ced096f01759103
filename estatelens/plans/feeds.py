"""Catalogue: streaming jobs, each run over all available data, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import filters as FL
from ..session import work_dir
from ..sources import adapters as A
from ..streaming import jobs as J
from ..streaming import stateful as S
from .context import Catalogue
from .fragments import r1, with_parts

catalogue = Catalogue()
add = catalogue.add


def _feed(t):
    """The events table as a stream."""
    schema = t.raw("events").schema
    return J.read_feed(t.spark, t.sf, schema, "events.parquet")


def _events(t, stream: bool):
    return _as_changes(_feed(t).withColumn("ts", F.col("ts").cast("timestamp")) if stream else t.raw("events"))


def _as_changes(e):
    return e.select(
        F.concat(F.lit("/repo_"), (F.col("user_id") % 4).cast("string")).alias("repo"),
        F.concat(F.lit("/file_"), F.col("user_id").cast("string")).alias("path"),
        (F.floor(F.least(F.col("value"), F.lit(50.0)) / 5.0 * 10 + 0.5) / 10).alias("rating"),
        F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("kind"),
        "ts",
        F.col("ts").alias("mtime"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("session_id"),
    )


def _run(t, stream, mode: str = "append"):
    folder = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    return J.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint", mode)


def _in_slices(t, job, flush: bool = False, slices: int = 3):
    """What a stateful job gives for all events, landed in slices of time; the job is restarted for each.

    ``flush`` lands a last row, of no repository, a day later: it moves the watermark past all that is open.
    """
    folder = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    events = t.raw("events")
    share = [k / slices for k in range(1, slices)]
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), share).alias("at"), F.max("ts").alias("last")).first()
    at, last = F.unix_micros(F.col("ts").cast("timestamp")), cuts["last"]
    parts = [events.where((at >= a if a is not None else F.lit(True)) & (at < b if b is not None else F.lit(True))) for a, b in zip([None, *(cuts["at"] or share)], [*(cuts["at"] or share), None], strict=True)]
    if flush and last is not None:
        nobody = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (F.lit(last) + F.expr("INTERVAL 1 DAY")).cast(f.dataType).alias("ts") for f in events.schema.fields]
        parts.append(t.spark.range(1).select(*nobody))
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/feed")
        feed = J.read_feed(t.spark, f"{folder}/feed", events.schema, per_trigger=100_000)
        S.run_feed(job(_as_changes(feed.withColumn("ts", F.col("ts").cast("timestamp")))), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


@add(
    "stream_upsert",
    with_parts("SELECT repo, path, arg_max(rating, (recorded_at, seq)) AS rating, arg_max(seq, (recorded_at, seq)) AS seq FROM history GROUP BY 1, 2", "history"),
)
def _(t):
    folder = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    rows = _events(t, True).select("repo", "path", "rating", F.col("ts").alias("analyzedAt"), "seq")
    J.upsert_feed(rows, f"{folder}/table", f"{folder}/history", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/table").select("repo", "path", "rating", "seq")


@add("stream_gate", with_parts("SELECT repo, path, rating, seq, CASE repo WHEN '/repo_1' THEN 8.0 WHEN '/repo_2' THEN 2.0 ELSE 6.5 END::DOUBLE AS min_rating FROM history WHERE rating < min_rating", "history"))
def _(t):
    gates = t.spark.createDataFrame([("/repo_1", 8.0), ("/repo_2", 2.0)], "repo string, min_rating double")
    return _run(t, J.gate_feed(_events(t, True), gates).select("repo", "path", "rating", "seq", "min_rating"))


_SESSIONS = """, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY repo ORDER BY ts, seq) + INTERVAL {gap} THEN 1 ELSE 0 END AS cut FROM changes),
  s AS (SELECT *, sum(cut) OVER (PARTITION BY repo ORDER BY ts, seq) AS sid FROM g)
  SELECT repo, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes FROM s GROUP BY repo, sid"""


@add("change_batches", with_parts(_SESSIONS.format(gap="'10 minutes'"), "changes"))
def _(t):
    return J.change_batches(_events(t, False), "10 minutes")


@add("stream_change_batches", with_parts(_SESSIONS.format(gap="'10 minutes'"), "changes"))
def _(t):
    # Complete mode: open batches at the end of the data are part of the result.
    out = _run(t, J.change_batches(_events(t, True), "10 minutes"), "complete")
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


_DETECT = """, p AS (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY ts, seq) AS pk, lag(mtime) OVER (PARTITION BY path ORDER BY ts, seq) AS pm FROM changes),
  d AS (SELECT path, seq, CASE WHEN kind = 'deleted' AND pk IS NOT NULL AND pk <> 'deleted' THEN 'deleted' WHEN kind <> 'deleted' AND (pk IS NULL OR pk = 'deleted') THEN 'new'
    WHEN kind <> 'deleted' AND mtime <> pm THEN 'modified' END AS kind FROM p) SELECT * FROM d WHERE kind IS NOT NULL"""


@add("change_detection", with_parts(_DETECT, "changes"))
def _(t):
    return J.change_sequence(_events(t, False)).select("path", "kind", "seq")


@add(
    "snapshot_changes",
    with_parts(
        """, b AS (SELECT path, max(mtime) AS m FROM changes WHERE kind <> 'new' GROUP BY 1), a AS (SELECT path, max(mtime) AS m FROM changes WHERE kind <> 'deleted' GROUP BY 1)
        SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.m IS DISTINCT FROM b.m""",
        "changes",
    ),
)
def _(t):
    c = t.changes
    last = lambda d: d.groupBy("path").agg(F.max("mtime").alias("mtime"))
    return J.detect_changes(last(c.filter("kind <> 'new'")), last(c.filter("kind <> 'deleted'")))


@add(
    "graph_deltas",
    with_parts(
        """SELECT n.id AS path, 'node' AS kind, '' AS source, '' AS target, n.rating FROM nodes n
        UNION ALL SELECT source, 'edge', source, target, -1 FROM sparse UNION ALL SELECT target, 'edge', source, target, -1 FROM sparse WHERE source <> target""",
        "nodes",
        "sparse",
    ),
)
def _(t):
    out = J.graph_deltas(t.nodes.select(F.col("id").alias("path")), t.nodes, t.sparse)
    return out.fillna("", ["source", "target"]).fillna(-1.0, ["rating"])


@add(
    "stream_graph_deltas",
    with_parts(
        """SELECT n.id AS path, 'node' AS kind, '' AS source, '' AS target, n.rating FROM nodes n
        UNION ALL SELECT source, 'edge', source, target, -1 FROM sparse UNION ALL SELECT target, 'edge', source, target, -1 FROM sparse WHERE source <> target""",
        "nodes",
        "sparse",
    ),
)
def _(t):
    folder = t.nodes.inputFiles()[0].rsplit("/", 1)[0]
    changed = J.read_feed(t.spark, folder, t.nodes.schema).select(F.col("id").alias("path"))
    out = _run(t, J.graph_deltas(changed, t.nodes, t.sparse))
    return out.fillna("", ["source", "target"]).fillna(-1.0, ["rating"])


@add("first_sessions", "SELECT user_id AS session_id, min(ts) AS ts FROM events GROUP BY 1")
def _(t):
    return J.first_sessions(_events(t, False))


@add("stream_sessions", "SELECT DISTINCT user_id AS session_id FROM events")
def _(t):
    return _run(t, J.first_sessions(_events(t, True)).select("session_id"))


@add("stream_scan_progress", "SELECT '/repo_' || (user_id % 4) AS scan_id, count(*) AS analyzed, CAST(floor(count(*) / 50) AS BIGINT) AS steps FROM events GROUP BY 1")
def _(t):
    return _run(t, J.scan_progress(_events(t, True).withColumnRenamed("repo", "scan_id")), "complete")


_ALERTS = with_parts(
    f""", p AS (SELECT *, lag(rating) OVER (PARTITION BY repo, path ORDER BY recorded_at, seq) AS prev FROM history),
    s AS (SELECT *, sum(round((rating - coalesce(prev, 0)) * 10)) OVER w AS t, count(*) FILTER (prev IS NULL) OVER w AS n FROM p WINDOW w AS (PARTITION BY repo ORDER BY recorded_at, seq ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, {r1('t / 10 / n')} AS overall FROM s)
    SELECT repo, recorded_at, seq, overall FROM m WHERE overall < 5 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY recorded_at, seq) = 1""",
    "history",
)


@add("low_rating_alerts", _ALERTS)
def _(t):
    return J.low_rating_alerts(t.history)


@add("stream_low_rating_alerts", _ALERTS)
def _(t):
    return _in_slices(t, S.low_rating_alerts).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))


@add("stream_latest_items", "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def _(t):
    feed = _feed(t).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return _run(t, J.latest_items(feed), "complete")


@add(
    "fan_out",
    """WITH m AS (SELECT event_id AS msg_id, CASE WHEN event_type <> 'view' THEN '/repo_' || (user_id % 4) END AS repo FROM events),
    s AS (SELECT 'client_' || n_nationkey AS client, CASE WHEN n_regionkey < 4 THEN '/repo_' || n_regionkey END AS repo FROM nation)
    SELECT client, msg_id FROM m, s WHERE m.repo IS NULL OR s.repo IS NULL OR m.repo = s.repo""",
)
def _(t):
    m = t.raw("events").select(F.col("event_id").alias("msg_id"), F.when(F.col("event_type") != "view", F.concat(F.lit("/repo_"), (F.col("user_id") % 4).cast("string"))).alias("repo"))
    s = t.raw("nation").select(
        F.concat(F.lit("client_"), F.col("n_nationkey").cast("string")).alias("client"),
        F.when(F.col("n_regionkey") < 4, F.concat(F.lit("/repo_"), F.col("n_regionkey").cast("string"))).alias("repo"),
    )
    return FL.fan_out(m, s)


def _ntz(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_WIN = f"SELECT repo, date_trunc('day', recorded_at) AS window_start, count(*) AS analyses, {r1('sum(round(rating * 10)) / 10 / count(*)')} AS overall_rating FROM history GROUP BY 1, 2"
_SLIDE = f"""SELECT repo, date_trunc('day', recorded_at) - to_days(CAST(k AS INT)) AS window_start, count(*) AS analyses, {r1('sum(round(rating * 10)) / 10 / count(*)')} AS overall_rating
  FROM history, range(0, 7) r(k) GROUP BY 1, 2"""


@add("rating_windows", with_parts(_WIN, "history"))
def _(t):
    return _ntz(J.rating_windows(t.history))


@add("rating_windows_sliding", with_parts(_SLIDE, "history"))
def _(t):
    return _ntz(J.rating_windows(t.history, "7 days", "1 day"))


@add("stream_rating_windows", with_parts(_WIN, "history"))
def _(t):
    return _ntz(_run(t, J.rating_windows(_events(t, True)), "complete"))


@add("stream_change_detection", with_parts(_DETECT, "changes"))
def _(t):
    return _in_slices(t, S.detect_changes)


@add(
    "batch_members",
    with_parts(_SESSIONS.format(gap="'10 minutes'").replace("SELECT repo, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes FROM s GROUP BY repo, sid",
        ", w AS (SELECT repo, sid, min(ts) AS first_ts FROM s GROUP BY repo, sid) SELECT DISTINCT s.repo, w.first_ts, s.path FROM s JOIN w ON w.repo = s.repo AND w.sid = s.sid"), "changes"),
)
def _(t):
    return J.batch_members(_events(t, False), "10 minutes")


@add(
    "stream_batch_members",
    with_parts(_SESSIONS.format(gap="'10 minutes'").replace("SELECT repo, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes FROM s GROUP BY repo, sid",
        ", w AS (SELECT repo, sid, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes FROM s GROUP BY repo, sid) SELECT DISTINCT s.repo, first_ts, last_ts, changes, s.path FROM s JOIN w ON w.repo = s.repo AND w.sid = s.sid"), "changes"),
)
def _(t):
    out = _in_slices(t, lambda e: S.debounced_paths(e, "10 minutes"), flush=True)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@add(
    "stream_scan_steps",
    """WITH n AS (SELECT '/repo_' || (user_id % 4) AS scan_id, count(*) AS n FROM events GROUP BY 1)
    SELECT scan_id, step, step * 50 AS analyzed FROM n, unnest(range(1, n // 50 + 1)) AS r(step)
    UNION ALL SELECT scan_id, n // 50 + 1, n FROM n WHERE n % 50 > 0""",
)
def _(t):
    totals = _events(t, False).groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    return _in_slices(t, lambda e: S.scan_steps(e.select("repo").join(totals, "repo").withColumnRenamed("repo", "scan_id")))


_PUSHED = """, f AS (SELECT DISTINCT l_orderkey AS push_id, path FROM lineitem JOIN files ON part = l_partkey),
  fd AS (SELECT target AS id, count(*) AS dd, count(*) FILTER (n.rating < 6) AS fd FROM local e JOIN nodes n ON n.id = e.source GROUP BY 1),
  g AS (SELECT push_id, count(*) FILTER (rating < 5 OR coalesce(fd, 0) >= 3) AS high, count(*) FILTER ((rating >= 5 AND rating < 7) OR coalesce(fd, 0) >= 1) AS medium, count(*) FILTER (rating >= 7 AND coalesce(fd, 0) = 0) AS low
    FROM f JOIN nodes ON id = path LEFT JOIN fd ON fd.id = path GROUP BY 1)
  SELECT *, CASE WHEN high > 0 THEN 'request-changes' WHEN medium > 0 THEN 'neutral' ELSE 'approve' END AS verdict FROM g"""


def _pushes(t):
    """Push events as (push_id, payload): a push lists the files of one order; an order has a handful of lines."""
    f = t.files.select("part", P.relative_path(F.col("repo"), "path").alias("file"))
    lines = t.raw("lineitem").join(f, F.col("l_partkey") == F.col("part"))
    payload = F.to_json(F.struct(F.lit("refs/heads/main").alias("ref"), F.array(F.struct(F.col("added"), F.col("modified"))).alias("commits")))
    pick = lambda cond: F.collect_list(F.when(cond, F.col("file")))
    pushes = lines.groupBy(F.col("l_orderkey").alias("push_id")).agg(
        pick(F.col("l_linestatus") == "O").alias("added"), pick(F.col("l_linestatus") != "O").alias("modified")
    )
    return pushes.select("push_id", payload.alias("payload"))


@add("push_verdicts", with_parts(_PUSHED, "local", "nodes", "files"))
def _(t):
    return J.push_verdicts(_pushes(t), t.local, t.nodes)


@add("stream_push_verdicts", with_parts(_PUSHED, "local", "nodes", "files"))
def _(t):
    """The pushes land in two parts; the job is restarted for the second."""
    folder = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    for k in range(2):
        _pushes(t).where(F.pmod("push_id", F.lit(2)) == k).write.mode("append").parquet(f"{folder}/feed")
        feed = t.spark.readStream.schema("push_id long, payload string").parquet(f"{folder}/feed")
        J.push_feed(feed, t.local, t.nodes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id")


@add(
    "stream_late_windows",
    with_parts(
        f""", b AS (SELECT epoch_us(min(recorded_at)) AS lo, epoch_us(max(recorded_at)) AS hi FROM history),
        h AS (SELECT history.*, epoch_us(recorded_at) < lo + (hi - lo) // 3 AS late, epoch_us(date_trunc('day', recorded_at)) + 86400000000 AS closes, hi FROM history, b)
        SELECT repo, date_trunc('day', recorded_at) AS window_start, count(*) AS analyses, {r1('sum(round(rating * 10)) / 10 / count(*)')} AS overall_rating
        FROM h WHERE NOT late OR closes > hi - 86400000000 GROUP BY 1, 2""",
        "history",
    ),
)
def _(t):
    """Append mode with a watermark of a day. The oldest third of the time lands last and comes too late for its windows."""
    folder = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    events = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("ts").alias("last")).first()
    parts = [events]
    if span["hi"] is not None:
        cut = span["lo"] + (span["hi"] - span["lo"]) // 3
        close = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields}
        close["ts"] = (F.lit(span["last"]) + F.expr("INTERVAL 9 DAYS")).alias("ts")  # moves the watermark past all windows
        parts = [events.where(at >= cut), events.where(at < cut), t.spark.range(1).select(*close.values())]
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/feed")
        feed = t.spark.readStream.schema(events.schema).parquet(f"{folder}/feed")
        J.run_to_table(J.rating_windows(_as_changes(feed)), f"{folder}/out", f"{folder}/checkpoint")
    return _ntz(t.spark.read.parquet(f"{folder}/out"))
