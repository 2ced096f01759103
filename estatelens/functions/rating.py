"""File rating: 10 minus weighted deductions, in whole tenths so that no binary rounding creeps in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points taken off per violation, in tenths.
SEVERITY_TENTHS = {"error": 15, "warning": 5, "info": 1}
# The same as points.
SEVERITY_POINTS = {"error": 1.5, "warning": 0.5, "info": 0.1}
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}


def js_num(x: Column) -> Column:
    """Number as text without a trailing ``.0``."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def round1(x: Column) -> Column:
    """Half-up rounding to one decimal."""
    return F.floor(x * 10 + 0.5) / 10


def severity_points(severity: Column, default: float | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, points in SEVERITY_POINTS.items():
        out = out.when(severity == name, F.lit(points))
    return out if default is None else out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in SEVERITY_RANK.items():
        out = out.when(severity == name, F.lit(rank))
    return out


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "error").when(rank == 2, "warning").otherwise("info")


def _ladder(*steps):
    """Deduction items of one metric: the first step whose condition holds."""
    out = None
    for cond, category, tenths, detail in steps:
        item = F.struct(F.lit(category).alias("category"), F.lit(tenths).alias("tenths"), detail.alias("detail"))
        out = F.when(cond, item) if out is None else out.when(cond, item)
    return out


def _count_item(n: Column, label: str, tenths: int, points: str) -> Column:
    text = n.cast("string")
    return F.when(
        n > 0,
        F.struct(
            F.concat(F.lit(f"{label} ("), text, F.lit(")")).alias("category"),
            (n * tenths).cast("int").alias("tenths"),
            F.concat(text, F.lit(f" × −{points} pts")).alias("detail"),
        ),
    )


def _items(errors, warnings, infos, loc, cc, methods, imports, coverage) -> Column:
    pct = F.format_string("%.1f", coverage)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    avg_lines = F.floor(loc / methods + 0.5)
    return F.array_compact(
        F.array(
            _count_item(errors, "Errors", 15, "1.5"),
            _count_item(warnings, "Warnings", 5, "0.5"),
            _count_item(infos, "Info hints", 1, "0.1"),
            _ladder(
                (coverage < 30, "Critical Coverage Gap", 25, say(pct, "% < 30% — changes are blind")),
                (coverage < 50, "Low Test Coverage", 20, say(pct, "% < 50%")),
                (coverage < 80, "Moderate Test Coverage", 10, say(pct, "% < 80%")),
            ),
            _ladder(
                (
                    methods > 40,
                    "Oversized Type",
                    15,
                    say(methods.cast("string"), " methods > 40 — violates Single Responsibility"),
                ),
                (methods > 20, "Large Type", 5, say(methods.cast("string"), " methods > 20")),
            ),
            _ladder(
                (
                    (methods > 0) & (avg_lines > 40),
                    "Long Methods (avg)",
                    10,
                    say("avg ", avg_lines.cast("string"), " LOC/method > 40"),
                )
            ),
            _ladder(
                (cc > 20, "High Complexity", 20, say("Complexity ", cc.cast("string"), " > 20")),
                (cc > 10, "Moderate Complexity", 10, say("Complexity ", cc.cast("string"), " > 10")),
            ),
            _ladder(
                (imports > 30, "High Coupling", 20, say(imports.cast("string"), " imports > 30")),
                (imports > 15, "Moderate Coupling", 5, say(imports.cast("string"), " imports > 15")),
            ),
            _ladder(
                (loc > 500, "Large File", 15, say(loc.cast("string"), " LOC > 500")),
                (loc > 300, "Medium File", 5, say(loc.cast("string"), " LOC > 300")),
            ),
        )
    )


def breakdown_from_counts(errors, warnings, infos, loc, cc, methods, imports, coverage) -> Column:
    """Deduction rows as array<struct<category, deduction, detail>>."""
    items = _items(errors, warnings, infos, loc, cc, methods, imports, coverage)
    return F.transform(
        items,
        lambda i: F.struct(
            i["category"].alias("category"), (i["tenths"] / 10).alias("deduction"), i["detail"].alias("detail")
        ),
    )


def rating_from_counts(errors, warnings, infos, loc, cc, methods, imports, coverage) -> Column:
    """Rating from severity counts and metrics: plain integer arithmetic, no array built."""
    step = lambda *pairs: _steps(pairs)
    avg_lines = F.floor(loc / F.when(methods > 0, methods) + 0.5)
    tenths = (
        F.lit(100)
        - errors * 15
        - warnings * 5
        - infos
        - step((coverage < 30, 25), (coverage < 50, 20), (coverage < 80, 10))
        - step((methods > 40, 15), (methods > 20, 5))
        - step((avg_lines > 40, 10))
        - step((cc > 20, 20), (cc > 10, 10))
        - step((imports > 30, 20), (imports > 15, 5))
        - step((loc > 500, 15), (loc > 300, 5))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), tenths)) / 10


def _steps(pairs) -> Column:
    out = None
    for cond, tenths in pairs:
        out = F.when(cond, F.lit(tenths)) if out is None else out.when(cond, F.lit(tenths))
    return out.otherwise(F.lit(0))


def severity_count(violations: Column, severity: str) -> Column:
    return F.size(F.filter(violations, lambda v: v["severity"] == severity))


def _from_arrays(violations: Column, metrics: Column):
    return (
        severity_count(violations, "error"),
        severity_count(violations, "warning"),
        severity_count(violations, "info"),
        metrics["linesOfCode"],
        metrics["cyclomaticComplexity"],
        metrics["numberOfMethods"],
        metrics["importCount"],
        metrics["coveragePercent"],
    )


def rating(violations: Column, metrics: Column) -> Column:
    return rating_from_counts(*_from_arrays(violations, metrics))


def breakdown(violations: Column, metrics: Column) -> Column:
    return breakdown_from_counts(*_from_arrays(violations, metrics))


def cycle_penalty(rating_col: Column, cycles: Column) -> Column:
    """One point off per cycle, never below zero."""
    return F.greatest(F.lit(0.0), rating_col - cycles)


def priority(severity: Column, confidence: Column) -> Column:
    """Fix priority: severity weight, divided by 3 unless the fix is deterministic."""
    weight = severity_points(severity, 0.1)
    return F.when(confidence == "deterministic", weight).otherwise(weight / 3)


def prioritise(violations: Column) -> Column:
    """Score every violation of a file and sort them by falling priority (stable by position)."""
    scored = F.transform(
        violations,
        lambda v, i: F.struct(
            (-priority(v["severity"], v["fix"]["confidence"])).alias("k"),
            i.alias("i"),
            v.withField("priorityScore", priority(v["severity"], v["fix"]["confidence"])).alias("v"),
        ),
    )
    return F.transform(
        F.array_sort(scored, lambda a, b: F.when((a["k"] < b["k"]) | ((a["k"] == b["k"]) & (a["i"] < b["i"])), -1).otherwise(1)),
        lambda s: s["v"],
    )


def health_label(r: Column) -> Column:
    return F.when(r >= 8, "Healthy").when(r >= 6, "Warning").when(r >= 4, "Degraded").otherwise("Critical")


def health_band(r: Column) -> Column:
    return F.when(r >= 8, "green").when(r >= 6, "yellow").when(r >= 4, "orange").otherwise("red")
