"""Row filters: exclude globs, ignore rules, quality gate, searches and queue filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rating as R
from ..rules import tables as RT

def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def excluded(files: DataFrame, rules: DataFrame, dialect: str = "scan") -> DataFrame:
    """Files hit by an exclude glob: ``rules`` has (lang_group, pattern), with group ``global`` for all.

    A glob is tried on the whole path and on the base name. Adds a boolean column ``excluded``.
    """
    r = rules.select(F.coalesce("lang_group", F.lit("global")).alias("grp"), P.glob_to_regex("pattern", dialect).alias("regex"))
    path, base = F.col("path"), P.basename("path")
    hit = lambda rx: F.rlike(path, rx) | F.rlike(base, rx)
    grp = P.language_group("path")
    # A rule set is a configuration: one array of patterns for each language group, and one for all files.
    sets = r.groupBy("grp").agg(F.collect_set("regex").alias("rx"))
    everywhere = r.filter("grp = 'global'").agg(F.collect_set("regex").alias("_rx0"))  # one row
    f = files.crossJoin(F.broadcast(everywhere))
    lang = sets.filter("grp <> 'global'").select(F.col("grp").alias("_g"), F.col("rx").alias("_rx1"))
    f = f.withColumn("_g", grp).join(lang, "_g", "left")
    tried = lambda c: F.coalesce(F.exists(c, hit), F.lit(False))
    return f.withColumn("excluded", tried("_rx0") | tried("_rx1")).drop("_g", "_rx0", "_rx1")


def not_excluded(files: DataFrame, rules: DataFrame, dialect: str = "scan") -> DataFrame:
    return excluded(files, rules, dialect).filter("NOT excluded").drop("excluded")


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Ignore-file verdict: the last matching rule of the file's repository wins, ``!`` re-includes.

    ``files`` has (repo, path); ``rules`` has (repo, ord, negate, anchored, regex). Anchored rules
    see the path relative to the repository, others the base name. Adds boolean ``ignored``.
    """
    rel, base = P.relative_path(F.col("repo"), F.col("path")), P.basename("path")
    # One ignore file per repository: its rules travel as one array, in order.
    sets = rules.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "negate", "anchored", "regex"))).alias("_rules"))
    f = files.withColumn("_rel", rel).withColumn("_base", base).join(sets, "repo", "left")
    last = F.aggregate(
        F.coalesce("_rules", F.array().cast(sets.schema["_rules"].dataType)),
        F.lit(False),
        lambda acc, r: F.when(F.rlike(F.when(r["anchored"], F.col("_rel")).otherwise(F.col("_base")), r["regex"]), ~r["negate"]).otherwise(acc),
    )
    return f.withColumn("ignored", last).drop("_rel", "_base", "_rules")


def filter_graph(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop excluded nodes and every edge that touches one (unanchored globs)."""
    gone = _marked(nodes, rules).filter("excluded").select("id")
    left = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(
        gone.select(F.col("id").alias("target")), "target", "left_anti"
    )
    return filter_nodes(nodes, rules), left


def filter_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The nodes of :func:`filter_graph`, which need no edges."""
    return _marked(nodes, rules).filter("NOT excluded").drop("excluded", "path")


def _marked(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    return excluded(nodes.withColumn("path", F.col("id")), rules.withColumn("lang_group", F.lit("global")), "dashboard")


def quality_gate(files: DataFrame, violations: DataFrame, min_rating: float = 6.5) -> DataFrame:
    """Reasons for every file below the gate: one row per violation with its message line."""
    bad = files.filter(F.col("rating") < min_rating).select("path", "rating")
    v = violations.select("path", "severity", "message", "line", F.col("fix.description").alias("fix"))
    loc = F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise("")
    fix = F.when(F.col("fix").isNotNull(), F.concat(F.lit(" — "), "fix")).otherwise("")
    return bad.join(v, "path", "left").select(
        "path",
        "rating",
        F.concat(
            P.basename("path"), F.lit(" rated "), R.js_num(F.col("rating")), F.lit("/10 (minimum "),
            F.lit(f"{min_rating:g}"), F.lit("/10)"),
        ).alias("headline"),
        F.concat(F.lit("["), "severity", F.lit("] "), "message", loc, fix).alias("reason"),
    )


def pass_count(files: DataFrame, min_rating: float = 7.0) -> DataFrame:
    return files.agg(F.count_if(F.col("rating") >= min_rating).alias("passing"), F.count(F.lit(1)).alias("files"))


def is_test_path(path: Column) -> Column:
    """Test marker used by the caller search."""
    return F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec."))


def is_test_file(path: Column) -> Column:
    return _any([F.rlike(path, F.lit(p)) for p in RT.TEST_FILE_PATTERNS])


def is_config_file(path: Column) -> Column:
    return _any([F.rlike(P.basename(path), F.lit(p)) for p in RT.CONFIG_FILE_PATTERNS])


def is_coverage_exempt(path: Column, content: Column) -> Column:
    return F.endswith(path, F.lit(".cs")) & F.coalesce(F.rlike(content, F.lit(RT.COVERAGE_EXEMPT)), F.lit(False))


def has_real_tests(content: Column) -> Column:
    """Whether a test file has any test call or assertion; unreadable files count as real."""
    return F.coalesce(_any([F.rlike(content, F.lit(p)) for p in RT.TEST_CONTENT_PATTERNS]), F.lit(True))


def search_nodes(nodes: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Case-insensitive substring search over label and id."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("label"), q) | F.contains(F.lower("id"), q)
    return nodes.filter(hit).orderBy("id").limit(limit)


def filter_violations(violations: DataFrame, severity: str = "all", text: str = "") -> DataFrame:
    """Violations by severity and by text in file label, message or type."""
    out = violations if severity == "all" else violations.filter(F.col("severity") == severity)
    if text.strip():
        q = F.lit(text.lower())
        out = out.filter(
            F.contains(F.lower(P.basename("path")), q) | F.contains(F.lower("message"), q) | F.contains(F.lower("type"), q)
        )
    return out


def filter_queue(queue: DataFrame, status: str | None = None, repo: str | None = None) -> DataFrame:
    """Queue items, optionally of one status and repository, highest priority first."""
    out = queue
    if status:
        out = out.filter(F.col("status") == status)
    if repo:
        out = out.filter(F.col("repo") == repo)
    return out.orderBy(F.desc("priority_score"), "id")


def stale_locks(locks: DataFrame, as_of: Column, ttl_seconds: int = 300) -> DataFrame:
    return locks.filter(F.col("locked_at") < as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def complexity_hotspots(nodes: DataFrame, limit: int = 5) -> DataFrame:
    return nodes.filter("complexity > 10").orderBy(F.desc("complexity"), "id").limit(limit)


def sort_files(nodes: DataFrame, field: str = "rating", direction: str = "asc") -> DataFrame:
    column = {"rating": "rating", "label": "label", "linesOfCode": "loc", "violations": "n_violations"}[field]
    key = F.col(column).asc() if direction == "asc" else F.col(column).desc()
    return nodes.orderBy(key, "id")


def hotspots(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Worst files: lowest rating first, most violations first among equals."""
    return nodes.orderBy("rating", F.desc("n_violations"), "id").limit(limit)


def merged_hotspots(nodes: DataFrame, per_repo: int = 10, limit: int = 5) -> DataFrame:
    """Hotspots over all repositories: the ten worst of each, then the five worst by rating."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy("rating", F.desc("n_violations"), "id")
    top = nodes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_repo)
    return top.orderBy("rating", "id").limit(limit).drop("rn")


def worst_files(nodes: DataFrame, limit: int = 10, below: float = 8.0) -> DataFrame:
    return nodes.orderBy("rating", "id").limit(limit).filter(F.col("rating") < below)


def scan_log_tail(log: DataFrame, limit: int = 500) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages each subscriber receives: those of its repository, or all where either side names none.

    ``subscriptions``: (client, repo or null); ``messages``: (msg_id, repo or null). Repository
    matches are an equi-join. All deliveries are spread over salts by message, so neither a busy
    repository or repository-less feed nor one client is handled in a single task.
    """
    subs = subscriptions.select("client", F.col("repo").alias("sub_repo"))
    salts = 32
    spread = lambda d: d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lambda d: d.withColumn("_k", F.pmod(F.xxhash64("msg_id"), F.lit(salts)).cast("int"))
    by_repo = spread(subs.filter("sub_repo IS NOT NULL").withColumnRenamed("sub_repo", "repo"))
    named = salted(messages).join(by_repo, ["repo", "_k"]).select("client", "msg_id")
    everything = salted(messages).join(spread(subs.filter("sub_repo IS NULL")), "_k")
    to_all = salted(messages.filter("repo IS NULL")).join(spread(subs.filter("sub_repo IS NOT NULL")), "_k")
    return named.unionByName(everything.select("client", "msg_id")).unionByName(to_all.select("client", "msg_id"))
