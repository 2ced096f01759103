"""Coverage roll-ups and the violations that follow from them.

The texts of messages, labels and questions here are fixed values: results must hold them word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rating as R
from . import filters as FL
from .joins import match_coverage, pair_tests
from .windows import uncovered_ranges


def coverage_rollup(lines: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Lines found, hit and percent per file; declared totals (LF / LH) win over counted ones.

    ``lines``: (path, line, hits), one row per line. ``declared``: (path, lf, lh). Files without
    any line count as fully covered.
    """
    counted = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") > 0).alias("h"))
    if declared is None:
        out = counted.select("path", F.col("n").alias("found"), F.col("h").alias("hit"))
    else:
        d = declared.groupBy("path").agg(F.max("lf").alias("lf"), F.max("lh").alias("lh"))
        both = counted.join(d, "path", "full_outer").fillna(0)
        given = F.col("lf") > 0
        out = both.select(
            "path", F.when(given, F.col("lf")).otherwise(F.col("n")).alias("found"), F.when(given, F.col("lh")).otherwise(F.col("h")).alias("hit")
        )
    pct = F.when(F.col("found") > 0, F.floor(F.col("hit") / F.col("found") * 1000 + 0.5) / 10).otherwise(F.lit(100.0))
    return out.withColumn("percent", pct)


def uncovered(lines: DataFrame) -> DataFrame:
    return lines.filter("hits = 0").select("path", "line")


def coverage_violations(files: DataFrame, lines: DataFrame, rollup: DataFrame) -> DataFrame:
    """Violations of files against an existing report: none, low, moderate, and uncovered lines."""
    entries = rollup.select(F.col("path").alias("cov_path"), F.lit(0).alias("seq"))
    matched = match_coverage(files, entries)
    f = files.select("path").distinct().join(matched, "path", "left")
    f = f.join(rollup.select(F.col("path").alias("cov_path"), "percent"), "cov_path", "left")
    pct = F.format_string("%.1f", F.col("percent"))
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])

    def row(df, typ, severity, message):
        return df.select("path", F.lit(typ).alias("type"), F.lit(severity).alias("severity"), message.alias("message"))

    none = row(
        f.filter("percent IS NULL"), "no_test_coverage", "warning",
        F.lit("File has no unit test coverage — add tests for this file"),
    )
    low = row(f.filter("percent < 50"), "low_test_coverage", "warning", say("Test coverage is ", pct, "% — aim for at least 80%"))
    mid = row(
        f.filter("percent >= 50 AND percent < 80"), "moderate_test_coverage", "info",
        say("Test coverage is ", pct, "% — consider improving to 80%+"),
    )
    ranges = uncovered_ranges(uncovered(lines)).withColumnRenamed("path", "cov_path")
    gaps = row(
        f.join(ranges, "cov_path"), "uncovered_lines", "info",
        say(F.col("n_lines").cast("string"), " lines not covered by tests: ", F.col("ranges")),
    )
    return none.unionByName(low).unionByName(mid).unionByName(gaps)


def missing_test_violations(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Without a report: files without a test file, and test files without a real test.

    ``files``: (path, root, content); ``listing``: (path, content) of all files.
    """
    checked = files.filter(~FL.is_test_file(F.col("path")) & ~FL.is_config_file(F.col("path")))
    checked = checked.filter(~FL.is_coverage_exempt(F.col("path"), F.col("content")))
    pair = pair_tests(checked, listing)
    real = listing.select(F.col("path").alias("test_path"), FL.has_real_tests(F.col("content")).alias("real"))
    p = pair.join(real.hint("merge"), "test_path", "left")
    gap = F.col("test_path").isNull()
    pick = lambda none, hollow: F.when(gap, none).otherwise(hollow)
    empty = F.concat(F.lit("Test file exists but contains no real test cases — "), P.basename("test_path"), F.lit(" is an empty shell"))
    return p.filter(gap | ~F.col("real")).select(
        "path",
        pick(F.lit("no_test_file"), F.lit("hollow_test_file")).alias("type"),
        pick(F.lit("warning"), F.lit("error")).alias("severity"),
        pick(F.lit("No corresponding test file found — add tests for this file"), empty).alias("message"),
    )


def rerate_with_coverage(files: DataFrame, violations: DataFrame, cov_violations: DataFrame, rollup: DataFrame) -> DataFrame:
    """Add coverage violations and percentages to the analyses and rate them again.

    ``files`` carries path, loc, cc, methods, imports; severity counts combine map-side.
    """
    v = violations.select("path", "severity").unionByName(cov_violations.select("path", "severity"))
    counts = v.groupBy("path").agg(
        *[F.count_if(F.col("severity") == s).alias(a) for s, a in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))]
    )
    entries = rollup.select(F.col("path").alias("cov_path"), F.lit(0).alias("seq"))
    matched = match_coverage(files, entries).join(rollup.select(F.col("path").alias("cov_path"), "percent"), "cov_path")
    missing = F.lit(0.0)
    out = files.join(counts, "path", "left").fillna(0, ["errors", "warnings", "infos"])
    out = out.join(matched.select("path", "percent"), "path", "left").withColumn("coverage", F.coalesce("percent", missing))
    c = F.col
    return out.select(
        "path", "errors", "warnings", "infos", "coverage",
        R.rating_from_counts(c("errors"), c("warnings"), c("infos"), c("loc"), c("cc"), c("methods"), c("imports"), c("coverage")).alias("rating"),
    )
