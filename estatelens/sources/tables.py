"""Reads and lookups on the stored engine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def load_analyses(spark: SparkSession, path: str) -> DataFrame:
    """The stored analyses table (Parquet, partitioned by repo)."""
    return spark.read.schema(S.ANALYSIS).parquet(path)


def newest_first(analyses: DataFrame, repo: str | None = None) -> DataFrame:
    """All analyses, or those of one repository, newest first."""
    out = analyses if repo is None else analyses.filter(F.col("repo") == repo)
    return out.orderBy(F.desc("analyzedAt"), "repo", "path")


def one_analysis(analyses: DataFrame, repo: str, path: str) -> DataFrame:
    return analyses.filter((F.col("repo") == repo) & (F.col("path") == path))


def from_blob(rows: DataFrame) -> DataFrame:
    """Parse JSON analyses: ``rows`` has (data string) and optionally seq.

    ``fix`` may be a string or an object; both become the fix struct. Times are epoch milliseconds.
    """
    d = rows.withColumn("a", F.from_json("data", S.RAW_ANALYSIS))
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0).cast("long")

    def fix(v):
        obj = F.from_json(v["fix"], S.FIX)
        is_obj = F.startswith(F.ltrim(v["fix"]), F.lit("{"))
        text = F.struct(
            v["fix"].alias("description"), F.lit(None).cast("string").alias("replacement"),
            F.lit(None).cast(S.SPAN).alias("replaceSpan"), F.lit(None).cast("string").alias("confidence"),
        )
        return F.when(is_obj, obj).when(v["fix"].isNotNull(), text)

    names = [f.name for f in S.VIOLATION]
    violations = F.transform(
        "a.violations", lambda v: F.struct(*[(fix(v) if n == "fix" else v[n]).alias(n) for n in names])
    )
    special = {
        "repo": F.coalesce("a.repoRoot", F.lit("")),
        "violations": violations,
        "analyzedAt": F.timestamp_millis("a.analyzedAt"),
        "seq": seq,
    }
    return d.select(*[special.get(f.name, F.col(f"a.{f.name}")).alias(f.name) for f in S.ANALYSIS])


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, edges and repositories of graph documents (one JSON document per file)."""
    doc = spark.read.schema(S.GRAPH_DOCUMENT).option("multiLine", True).json(path)
    return {
        "nodes": doc.select("repo", F.explode("nodes").alias("n")).select("repo", "n.*"),
        "edges": doc.select("repo", F.explode("edges").alias("e")).select("repo", "e.*"),
        "repos": doc.select(F.explode("repos").alias("r")).select("r.*"),
    }


def repositories(
    repos: DataFrame, active_only: bool = False, repo_id=None, path: str | None = None, session_id=None
) -> DataFrame:
    """Repository rows, newest first, by any of: active flag, id, path, session."""
    out = repos.filter("is_active") if active_only else repos
    for column, value in (("id", repo_id), ("path", path), ("session_id", session_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), "id")


def analysed_repos(analyses: DataFrame) -> DataFrame:
    return analyses.filter("repo <> ''").select("repo").distinct().orderBy("repo")


def repo_list(registered: DataFrame, analyses: DataFrame) -> DataFrame:
    """Registered and analysed repositories with file counts; a registered name wins."""
    counts = analyses.filter("repo <> ''").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    r = registered.select(F.col("path").alias("repo"), "name", "session_type")
    return r.join(counts, "repo", "full_outer").select(
        "repo",
        F.coalesce("name", F.substring_index("repo", "/", -1)).alias("label"),
        F.coalesce("n", F.lit(0)).alias("file_count"),
        F.coalesce("session_type", F.lit("unknown")).alias("session_type"),
    )


def repo_key(path):
    """Stable key of a repository path."""
    return F.md5(path)


def normalise_fix(violations: DataFrame) -> DataFrame:
    """Replace a fix kept as text or JSON by its display text."""
    return violations.withColumn("fix", X.fix_text(F.col("fix")))
