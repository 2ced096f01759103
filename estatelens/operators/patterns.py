"""Aggregate reports over violations, ratings, queues and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rating as R
from ..functions import text as X
from ..rules import tables as RT

SEVERITIES = ("error", "warning", "info")


def _gain_tenths(severity):
    out = F.lit(0)
    for name, tenths in R.SEVERITY_TENTHS.items():
        out = F.when(severity == name, F.lit(tenths)).otherwise(out)
    return out


def violation_patterns(violations: DataFrame, sample: int | None = 10) -> DataFrame:
    """One row per violation type: worst severity, files, occurrences, gain if fixed, sample files.

    Files are counted on (type, path) pairs first, so a type that makes up a third of all rows is
    already spread out; ``sample_files`` has the first ``sample`` paths in order, or all where ``sample`` is None.
    """
    pairs = violations.groupBy("type", "path").agg(
        F.count(F.lit(1)).alias("n"), F.max(R.severity_rank(F.col("severity"))).alias("rank")
    )
    total = pairs.groupBy("type").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("total_occurrences")
    )
    w = Window.partitionBy("type").orderBy("path")
    some = pairs if sample is None else pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= sample)
    names = some.groupBy("type").agg(F.sort_array(F.collect_list("path")).alias("sample_files"))
    advice = RT.suggestion_table(violations.sparkSession)
    severity = R.severity_name(F.col("rank"))
    fallback = F.concat(F.lit("Fix all "), "type", F.lit(" occurrences codebase-wide."))
    return (
        total.join(names, "type")
        .join(F.broadcast(advice), "type", "left")
        .select(
            F.col("type").alias("violation_type"),
            severity.alias("severity"),
            "file_count",
            "total_occurrences",
            "sample_files",
            (F.col("total_occurrences") * _gain_tenths(severity) / 10).alias("estimated_gain"),
            F.coalesce("suggestion", fallback).alias("suggestion"),
        )
    )


def pattern_fix_order(violations: DataFrame) -> DataFrame:
    """Files touched by any pattern, each once."""
    return violations.select("path").distinct()


def pattern_total_gain(violations: DataFrame) -> DataFrame:
    """Rating points that all patterns together cost, one row: (patterns, total_gain)."""
    worst = violations.groupBy("type").agg(F.max(R.severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("n"))
    tenths = F.coalesce(F.sum(F.col("n") * _gain_tenths(R.severity_name(F.col("rank")))), F.lit(0))
    return worst.agg(F.count(F.lit(1)).alias("patterns"), (tenths / 10).alias("total_gain"))


def overall_rating(nodes: DataFrame, mode: str = "graph") -> DataFrame:
    """Overall rating in one of five definitions.

    graph: rounded mean, 10 when empty. stored: plain mean, 10 when empty. merged: rounded mean of
    the rounded means per repository. health: rounded mean. loc_weighted: mean weighted by lines of
    code (at least 1), null when empty.
    """
    if mode == "graph":
        return nodes.agg(F.coalesce(R.round1(F.avg("rating")), F.lit(10.0)).alias("overall_rating"))
    if mode == "stored":
        return nodes.agg(F.coalesce(F.avg("rating"), F.lit(10.0)).alias("overall_rating"))
    if mode == "merged":
        per = nodes.groupBy("repo").agg(R.round1(F.avg("rating")).alias("r"))
        return per.agg(F.coalesce(R.round1(F.avg("r")), F.lit(10.0)).alias("overall_rating"))
    if mode == "health":
        return nodes.agg(R.round1(F.avg("rating")).alias("overall_rating"))
    if mode == "loc_weighted":
        w = F.greatest(F.coalesce("loc", F.lit(1)), F.lit(1))
        return nodes.agg(R.round1(F.sum(F.col("rating") * w) / F.sum(w)).alias("overall_rating"))
    raise ValueError(f"unknown mode: {mode}")


def rating_distribution(nodes: DataFrame) -> DataFrame:
    r = F.col("rating")
    return nodes.agg(
        F.count_if(r >= 8).alias("excellent"), F.count_if((r >= 6) & (r < 8)).alias("good"), F.count_if(r < 6).alias("poor")
    )


def codebase_health(nodes: DataFrame, violations: DataFrame, min_rating: float = 7.0) -> dict[str, DataFrame]:
    """Named result tables: summary, worst files below the gate, most common violation types."""
    r = F.col("rating")
    mean = R.round1(F.avg("rating"))
    summary = nodes.agg(
        mean.alias("avg_rating"),
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(r >= 8).alias("excellent"),
        F.count_if((r >= 6) & (r < 8)).alias("good"),
        F.count_if(r < 6).alias("poor"),
        F.count_if(r >= min_rating).alias("passing"),
        (mean >= min_rating).alias("passed"),
    )
    worst = nodes.orderBy("rating", "id").limit(10).filter(r < min_rating).select(F.col("id").alias("path"), "rating", "n_violations")
    common = violations.groupBy("type").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "type").limit(10)
    return {"summary": summary, "worst": worst, "common": common}


def severity_by_file(violations: DataFrame) -> DataFrame:
    """Severity counts per file."""
    return (
        violations.groupBy("path").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).fillna(0, list(SEVERITIES))
    )


def severity_totals(violations: DataFrame) -> DataFrame:
    return violations.agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def grouped_violations(violations: DataFrame) -> DataFrame:
    """Violations with their file's total; sort by (file_total desc, path) for the grouped view.

    The groups stay long rows: a file with very many violations is never one cell.
    """
    total = violations.groupBy("path").agg(F.count(F.lit(1)).alias("file_total"))
    return violations.join(total, "path")


def queue_stats(queue: DataFrame) -> DataFrame:
    """Items per status, zero-filled, with the total."""
    statuses = ("pending", "in_progress", "completed", "failed", "skipped")
    return queue.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]
    ).withColumn("percent_complete", X.percent(F.col("completed"), F.col("total")))


def queue_stats_by_status(queue: DataFrame) -> DataFrame:
    """Items per repository and status with roll-up totals."""
    return queue.rollup("repo", "status").agg(F.count(F.lit(1)).alias("items")).select(
        F.coalesce("repo", F.lit("(all)")).alias("repo"), F.coalesce("status", F.lit("(all)")).alias("status"), "items"
    )


def _saved(log: DataFrame) -> DataFrame:
    tokens = F.ceil(F.col("response_chars") / 4)
    return log.withColumn("tokens", tokens).withColumn("saved", F.col("files_not_read") * X.AVG_FILE_TOKENS - tokens)


def session_metrics(log: DataFrame) -> DataFrame:
    """Token totals of a query log, with both savings: clamped per call and clamped in total."""
    naive = F.sum("files_not_read") * X.AVG_FILE_TOKENS
    t = _saved(log).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum("files_not_read").alias("total_files_not_read"),
        naive.alias("naive_tokens"),
        F.sum("tokens").alias("response_tokens"),
        F.sum(F.greatest(F.lit(0), F.col("saved"))).alias("saved_per_call"),
        F.greatest(F.lit(0), naive - F.sum("tokens")).alias("saved_total"),
    )
    pct = lambda c: F.coalesce(X.percent(F.col(c), F.col("naive_tokens")), F.lit(0)).cast("long")
    return t.withColumn("percent_per_call", pct("saved_per_call")).withColumn("percent_total", pct("saved_total"))


def tool_metrics(log: DataFrame) -> DataFrame:
    return _saved(log).groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("files_not_read").alias("files_avoided"),
        F.sum(F.greatest(F.lit(0), F.col("saved"))).alias("tokens_saved"),
    )


def quality_trend(nodes: DataFrame, queue: DataFrame, min_rating: float) -> DataFrame:
    """Trend snapshot per repository: rating, files, passed, failed, and queue items still open."""
    n = nodes.groupBy("repo").agg(
        R.round1(F.avg("rating")).alias("overall_rating"),
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(F.col("rating") >= min_rating).alias("files_passed"),
        F.count_if(F.col("rating") < min_rating).alias("files_failed"),
    )
    q = queue.groupBy("repo").agg(F.count_if(F.col("status") == "pending").alias("files_pending"))
    return n.join(q, "repo", "left").fillna(0, ["files_pending"])


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Attempts per queue item, rating gain from the first to the last attempt, violations fixed."""
    a = F.col("attempt")
    return attempts.groupBy("queue_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        (F.max_by("rating_after", a) - F.min_by("rating_before", a)).alias("rating_gain"),
        F.sum("violations_fixed").alias("violations_fixed"),
    )


def repo_stats(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"), F.avg("rating").alias("overall_rating"))


def refactoring_hints(violations: DataFrame, metrics: DataFrame, cycles: DataFrame) -> DataFrame:
    """Hints per file: rule hints from violations, the import hint, the cycle hint.

    ``violations``: (path, type, severity); ``metrics``: (path, imports); ``cycles``: (path,
    n_cycles). Output ordered by (path, gain desc, priority).
    """
    spark = violations.sparkSession
    rules = F.broadcast(RT.refactoring_table(spark))
    v = (
        violations.groupBy("path", "type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_gain_tenths(F.col("severity"))).alias("tenths"))
        .join(rules, "type")
        .select("path", F.col("type").alias("violation_type"), "pattern_name", "priority", "rationale", "steps", (F.col("tenths") / 10).alias("gain"))
    )
    name, priority, why, steps = RT.HIGH_IMPORT_HINT
    m = metrics.filter(F.col("imports") > 15).select(
        "path", F.lit("high_import_count").alias("violation_type"), F.lit(name).alias("pattern_name"),
        F.lit(priority).alias("priority"), F.lit(why).alias("rationale"), F.array(*[F.lit(s) for s in steps]).alias("steps"),
        F.when(F.col("imports") > 30, 2.0).otherwise(0.5).alias("gain"),
    )
    n = F.col("n_cycles").cast("string")
    name, priority, steps = RT.CYCLE_HINT
    c = cycles.filter("n_cycles > 0").select(
        "path", F.lit("circular_dependency").alias("violation_type"), F.lit(name).alias("pattern_name"),
        F.lit(priority).alias("priority"),
        F.concat(F.lit("This file participates in "), n, F.lit(" circular dependency cycle(s), costing −"), n, F.lit(".0 rating.")).alias("rationale"),
        F.array(*[F.lit(s) for s in steps]).alias("steps"),
        F.col("n_cycles").cast("double").alias("gain"),
    )
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return v.unionByName(m).unionByName(c).withColumn("priority_rank", rank)
