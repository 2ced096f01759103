"""Set operations on graphs: merge, union, cross-repository index, diffs and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_graphs(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> dict[str, DataFrame]:
    """Union of two graphs: B's node replaces A's, with the lower rating where they differ.

    Returns nodes (id, label, rating), edges (A's entry wins) and conflicts.
    """
    a = nodes_a.select("id", F.col("label").alias("la"), F.col("rating").alias("ra"))
    b = nodes_b.select("id", F.col("label").alias("lb"), F.col("rating").alias("rb"), F.lit(True).alias("in_b"))
    both = a.join(b, "id", "full_outer")
    differs = F.col("ra") != F.col("rb")
    nodes = both.select(
        "id",
        F.when(F.col("in_b"), F.col("lb")).otherwise(F.col("la")).alias("label"),
        F.when(differs, F.least("ra", "rb")).when(F.col("in_b"), F.col("rb")).otherwise(F.col("ra")).alias("rating"),
    )
    conflicts = both.filter(differs).select(
        "id", F.col("ra").alias("rating_a"), F.col("rb").alias("rating_b"), F.least("ra", "rb").alias("resolved")
    )
    cols = ["source", "target", "type", "strength"]
    tagged = edges_a.select(*cols, F.lit(0).alias("pos")).unionByName(edges_b.select(*cols, F.lit(1).alias("pos")))
    edges = tagged.groupBy("source", "target").agg(F.min_by(F.struct("type", "strength"), F.struct("pos", "type", "strength")).alias("f"))
    edges = edges.select("source", "target", F.col("f.type").alias("type"), F.col("f.strength").alias("strength"))
    return {"nodes": nodes, "edges": edges, "conflicts": conflicts}


def union_graphs(*frames: DataFrame) -> DataFrame:
    """Nodes (or edges) of several repositories side by side, without de-duplication."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repo_prefix(label):
    """Label with every character outside letters, digits, _ and - replaced."""
    return F.regexp_replace(label, "[^a-zA-Z0-9_-]", "_")


def index_repos(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross-repository ids: ``prefix:id``. Needs a ``repo_label`` column on both tables."""
    p = repo_prefix("repo_label")
    e = edges.select(
        F.concat(p, F.lit(":"), "source").alias("source"),
        F.concat(repo_prefix(F.coalesce("target_label", "repo_label")) if "target_label" in edges.columns else p, F.lit(":"), "target").alias("target"),
        "type",
    )
    return index_nodes(nodes), e


def index_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of :func:`index_repos`, which need no edges."""
    p = repo_prefix("repo_label")
    return nodes.select(p.alias("prefix"), F.concat(p, F.lit(":"), "id").alias("id"), "label", "rating")


def replace_repos(global_rows: DataFrame, fresh: DataFrame, key: str = "prefix") -> DataFrame:
    """Re-index: rows of the repositories in ``fresh`` replace their old rows."""
    return global_rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def cross_repo_edges(edges: DataFrame) -> DataFrame:
    """Indexed edges whose endpoints belong to different repositories."""
    a, b = F.substring_index("source", ":", 1), F.substring_index("target", ":", 1)
    return edges.filter(a != b).select("source", "target", a.alias("from_repo"), b.alias("to_repo"))


def global_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_distinct("prefix").alias("repos"), F.count(F.lit(1)).alias("nodes"))
    cross = F.substring_index("source", ":", 1) != F.substring_index("target", ":", 1)
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(cross).alias("cross_repo_imports"))
    # One row each: joined on a constant, not a product of tables.
    return n.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k").drop("_k")


def worst_nodes(nodes: DataFrame, limit: int = 5) -> DataFrame:
    return nodes.orderBy("rating", "id").limit(limit).select("id", "label", "rating")


def dependency_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added and removed between two snapshots, compared on (source, target, type)."""
    k = ["source", "target", "type"]
    b, a = before.select(*k).distinct(), after.select(*k).distinct()
    added = a.join(b, k, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(b.join(a, k, "left_anti").withColumn("change", F.lit("removed")))


def apply_deltas(base: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Last write per key wins; both inputs carry ``seq`` and a delta beats the base on a tie."""
    cols = [c for c in base.columns if c not in keys + ["seq"]]
    both = base.select(*keys, *cols, "seq", F.lit(0).alias("_d")).unionByName(deltas.select(*keys, *cols, "seq", F.lit(1).alias("_d")))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*cols, "seq"), F.struct("seq", "_d")).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols], F.col("r.seq").alias("seq"))


def changed_files(commits: DataFrame) -> DataFrame:
    """Files added or modified by any commit of a push; ``commits``: (push_id, added, modified)."""
    empty = F.array().cast("array<string>")
    files = F.concat(F.coalesce("modified", empty), F.coalesce("added", empty))
    return commits.select("push_id", F.explode(files).alias("file")).distinct()
