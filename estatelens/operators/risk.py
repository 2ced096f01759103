"""Edit-risk verdicts. Each verdict keeps its own rule; they differ on purpose.

The texts of messages, labels and questions here are fixed values: results must hold them word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rating as R
from ..session import materialize
from .traverse import FRAGILE, impact_set


def _counts(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int, hit: DataFrame | None = None) -> DataFrame:
    """Impact totals of each root, zero where nothing depends on it, with the root's own rating."""
    roots = roots.select("root").distinct()
    hit = impact_set(edges, nodes, roots, depth) if hit is None else hit
    direct = F.col("severity") == "direct"
    agg = hit.groupBy("root").agg(
        F.count(F.lit(1)).alias("affected"),
        F.count_if(direct).alias("direct_dependents"),
        F.count_if("fragile").alias("fragile"),
        F.count_if(F.col("fragile") & direct).alias("direct_fragile"),
        # Ratings have one decimal: whole tenths sum to the same value in any order.
        F.sum(F.when(F.col("fragile"), F.lit(60) - F.round(F.col("rating") * 10).cast("long")).otherwise(0)).alias("gap_tenths"),
    )
    out = roots.join(agg, "root", "left").fillna(0)
    own = nodes.select(F.col("id").alias("root"), F.col("rating").alias("file_rating"))
    return out.join(own, "root", "left")


def risk_scores(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Risk score 0..10 of each root: twice the fragile count plus their mean gap to 6, rounded."""
    c = _counts(edges, nodes, roots, depth)
    f = F.col("fragile")
    score = F.least(F.lit(10), F.floor(f * 2 + F.col("gap_tenths") / 10 / F.when(f > 0, f) + 0.5))
    return c.select("root", "affected", f.alias("fragile_count"), F.when(f > 0, score).otherwise(0).cast("long").alias("risk_score"))


def impact_verdicts(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """safe / warn / block by the number of fragile dependents within ``depth`` hops."""
    c = _counts(edges, nodes, roots, depth)
    f = F.col("fragile")
    return c.select(
        "root",
        "file_rating",
        "affected",
        "direct_dependents",
        f.alias("fragile_count"),
        F.when(f >= 3, 10).when(f >= 1, 5).otherwise(0).alias("risk_score"),
        F.when(f >= 3, "block").when(f >= 1, "warn").otherwise("safe").alias("verdict"),
        F.when(f >= 3, F.concat(f.cast("string"), F.lit(" fragile dependents — high risk of cascading failures")))
        .when(f >= 1, F.concat(f.cast("string"), F.lit(" fragile dependent(s) — verify after change")))
        .otherwise("Low blast radius")
        .alias("reason"),
    )


def edit_safety(edges: DataFrame, nodes: DataFrame, roots: DataFrame, named: int | None = 3) -> DataFrame:
    """Go / warn / block before an edit, looking three hops deep, with advice that names files (None: all fragile ones)."""
    roots = roots.select("root").distinct()
    hit = materialize(impact_set(edges, nodes, roots, 3), "impact").df
    c = _counts(edges, nodes, roots, 3, hit)
    f, d, a = F.col("fragile"), F.col("direct_fragile"), F.col("affected")
    verdict = F.when((f == 0) & (a < 5), "safe").when((d >= 3) | (f >= 5), "block").otherwise("warn")
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    reason = (
        F.when(F.col("verdict") == "safe", say("Low blast radius (", a, " affected files, none fragile)."))
        .when(F.col("verdict") == "block", say(f, " fragile dependents (", d, " direct). High risk of cascading failures."))
        .otherwise(say(f, " fragile dependent(s) — verify after change."))
    )
    hit = hit.filter("fragile")
    w = Window.partitionBy("root").orderBy("depth", "rating", "path")
    first = hit.withColumn("rn", F.row_number().over(w)).filter(F.lit(True) if named is None else F.col("rn") <= named)
    names = first.groupBy("root").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rn", F.substring_index("path", "/", -1).alias("n")))), lambda x: x["n"]
            ),
            ", ",
        ).alias("names")
    )
    unsafe = F.col("verdict") != "safe"
    advice = F.array_compact(
        F.array(
            F.when(
                unsafe & (F.col("file_rating") >= 7),
                "Source file is healthy — changes are lower risk if interface is preserved.",
            ),
            F.when(unsafe & (f > 0), F.concat(F.lit("Fix fragile dependents first: "), "names")),
            F.when(unsafe, "Use `get_impact_set` with depth=1 to see direct dependents only."),
            F.when(unsafe, "Use `summarize_file` on each fragile dependent to understand coupling."),
        )
    )
    return (
        c.withColumn("verdict", verdict)
        .withColumn("reason", reason)
        .join(names, "root", "left")
        .select("root", "file_rating", "affected", f.alias("fragile_count"), d.alias("direct_fragile"), "verdict", "reason", advice.alias("suggestions"))
    )


def assess_changed_files(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Traffic light of each changed file (column ``path``), with all reasons."""
    c = _counts(edges, nodes, changed.select(F.col("path").alias("root")), 2)
    r, f, d = F.col("file_rating"), F.col("fragile"), F.col("direct_dependents")
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    red = F.coalesce(r < 5, F.lit(False)) | (f >= 3) | (d >= 10)
    yellow = F.coalesce(r < 7, F.lit(False)) | (f >= 1) | (d >= 3)
    rating, fs, ds = R.js_num(r), f.cast("string"), d.cast("string")
    reasons = F.array_compact(
        F.array(
            F.when(r < 5, say("Low quality file (rating ", rating, "/10)")).when(
                r < 7, say("Below-threshold quality (rating ", rating, "/10)")
            ),
            F.when(f >= 3, say(fs, " fragile dependents (rating<6) will be impacted")).when(
                f >= 1, say(fs, " fragile dependent(s) may be impacted")
            ),
            F.when(d >= 10, say("God node — ", ds, " direct dependents")).when(d >= 3, say(ds, " direct dependents")),
        )
    )
    fine = F.when(r.isNotNull(), say("Healthy file (rating ", rating, "/10)")).otherwise("Not yet analyzed")
    return c.select(
        F.col("root").alias("path"),
        F.when(red, "RED").when(yellow, "YELLOW").otherwise("GREEN").alias("verdict"),
        r.alias("rating"),
        "direct_dependents",
        f.alias("fragile_impacted"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(fine)).alias("reasons"),
    )


def review_verdicts(changed: DataFrame, assessed: DataFrame, key: str = "pr") -> DataFrame:
    """Overall verdict and counts of each pull request; ``changed`` has (key, path)."""
    a = changed.select(key, "path").distinct().join(assessed.select("path", "verdict"), "path")
    agg = a.groupBy(key).agg(
        F.count(F.lit(1)).alias("changed_files"),
        *[F.count_if(F.col("verdict") == v).alias(f"{v.lower()}_files") for v in ("RED", "YELLOW", "GREEN")],
    )
    red, yellow = F.col("red_files"), F.col("yellow_files")
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    return agg.withColumn(
        "overall_verdict", F.when(red > 0, "RED").when(yellow > 0, "YELLOW").otherwise("GREEN")
    ).withColumn(
        "recommendation",
        F.when(red > 0, say("Request changes — ", red, " high-risk file(s) need attention before merge."))
        .when(yellow > 0, say("Review carefully — ", yellow, " medium-risk file(s). Verify downstream impact."))
        .otherwise("Approve — all changed files are low-risk (no fragile dependents, quality ≥ 7)."),
    )


def comment_rows(summaries: DataFrame) -> DataFrame:
    """Risk label of each row of a pull-request comment; needs rating and fragile_dependents."""
    red, yellow, _ = _buckets()
    return summaries.withColumn("risk", F.when(red, "HIGH").when(yellow, "MEDIUM").otherwise("LOW"))


def comment_verdicts(summaries: DataFrame, key: str = "pr") -> DataFrame:
    """Header counts and verdict of each comment. A file may count both as high and as medium."""
    red, yellow, green = _buckets()
    agg = summaries.groupBy(key).agg(
        F.count_if(red).alias("high"), F.count_if(yellow).alias("medium"), F.count_if(green).alias("low")
    )
    return agg.withColumn(
        "verdict",
        F.when(F.col("high") > 0, "request-changes").when(F.col("medium") > 0, "neutral").otherwise("approve"),
    )


def _buckets() -> tuple[Column, Column, Column]:
    r, f = F.col("rating"), F.col("fragile_dependents")
    return (r < 5) | (f >= 3), ((r >= 5) & (r < 7)) | (f >= 1), (r >= 7) & (f == 0)


def push_summaries(files: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph context of pushed files (repo-relative names) matched to nodes by path suffix.

    A node offers one key per suffix length that occurs among the pushed names; the least id wins.
    The right side is therefore unique per key, and no pairs of equal base names are formed.
    Needs node columns id, rating, errors, warnings.
    """
    f = files.select("file").distinct().withColumn("_len", F.size(F.split("file", "/")))
    # Path depths are small numbers; the list of distinct ones is bounded by the deepest path.
    lengths = [r[0] for r in f.select("_len").distinct().collect()]
    parts = F.split("id", "/")
    keys = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/")) for n in lengths])
    offered = (
        nodes.select("id", F.explode(F.array_compact(keys)).alias("file")).groupBy("file").agg(F.min("id").alias("id"))
        if lengths
        else nodes.select(F.col("id").alias("file"), "id").limit(0)
    )
    matched = f.select("file").join(offered, "file").join(nodes.select("id", "rating", "errors", "warnings"), "id")
    dep = edges.select("source", F.col("target").alias("id"))
    direct = dep.groupBy("id").agg(F.count(F.lit(1)).alias("direct_dependents"))
    weak = nodes.filter(F.col("rating") < FRAGILE).select(F.col("id").alias("source"))
    fragile = (
        dep.distinct().join(weak, "source", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("fragile_dependents"))
    )
    return (
        matched.join(direct, "id", "left")
        .join(fragile, "id", "left")
        .fillna(0, ["direct_dependents", "fragile_dependents"])
        .select("file", "id", "rating", "direct_dependents", "fragile_dependents", "errors", "warnings")
    )


def suggested_reviewers(changed: DataFrame, owners: DataFrame, key: str = "pr") -> DataFrame:
    """Reviewers of each pull request: owners of the file, else of its module; first file wins.

    ``changed``: (key, path relative to the repo, ord); ``owners``: (name, reviewer), where name is
    a file path or a module.
    """
    from ..functions import paths as P

    c = changed.withColumn("module", P.module_of("path", None, P.MODULE_PREFIXES_NARROW))
    own = owners.select("name", "reviewer").distinct()
    by_file = c.join(own.withColumnRenamed("name", "path"), "path")
    has_file = own.select(F.col("name").alias("path")).distinct()
    # Only the first file of a module counts, so changes and owners are not multiplied.
    rest = c.join(has_file, "path", "left_anti").groupBy(key, "module").agg(F.min(F.struct("ord", "path")).alias("m"))
    by_module = rest.select(key, "module", "m.path", "m.ord").join(own.withColumnRenamed("name", "module"), "module")
    cols = [key, "path", "ord", "reviewer"]
    both = by_file.select(*cols).unionByName(by_module.select(*cols))
    return both.groupBy(key, "reviewer").agg(F.min_by("path", F.struct("ord", "path")).alias("because_of"))
