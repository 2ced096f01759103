"""Report tables assembled from other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rating as R
from .centrality import degree_centrality
from .coupling import _top, module_rollup, suggested_questions, surprising


def graph_report(edges: DataFrame, nodes: DataFrame, components: DataFrame, top: int = 5) -> DataFrame:
    """Report rows of every repository: (repo, section, ord, item, value)."""
    text = lambda c: F.col(c).cast("string")
    owner = nodes.select(F.col("id").alias("source"), "repo")
    counts = (
        nodes.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("files"), R.round1(F.avg("rating")).alias("overall"))
        .join(edges.join(owner, "source").groupBy("repo").agg(F.count(F.lit(1)).alias("relations")), "repo", "left")
        .join(
            components.join(nodes.select(F.col("id").alias("path"), "repo"), "path").groupBy("repo").agg(F.count_distinct("component").alias("cycles")),
            "repo",
            "left",
        )
        .fillna(0, ["relations", "cycles"])
    )
    header = counts.select(
        "repo",
        F.lit("header").alias("section"),
        F.expr(
            "stack(4, 1, 'files', cast(files AS string), 2, 'relationships', cast(relations AS string), "
            "3, 'overall_rating', format_string('%.1f', overall), 4, 'cycles', cast(cycles AS string))"
        ).alias("ord", "item", "value"),
    )
    god = _top(degree_centrality(edges, nodes), top, F.desc("total_degree"), "path", keep=["path", "total_degree"]).select(
        "repo", F.lit("god_nodes").alias("section"), F.col("rn").alias("ord"), F.col("path").alias("item"), text("total_degree").alias("value")
    )
    odd = surprising(edges, nodes, top).select(
        "repo", F.lit("surprising").alias("section"), F.col("rank").alias("ord"), F.concat("source", F.lit(" -> "), "target").alias("item"), F.col("explanation").alias("value")
    )
    ask = suggested_questions(edges, nodes, 5).select(
        "repo", F.lit("questions").alias("section"), "ord", F.col("question").alias("item"), F.col("tool").alias("value")
    )
    mod = module_rollup(nodes).select(
        "repo", F.lit("modules").alias("section"), F.col("rank").alias("ord"), F.col("module").alias("item"),
        F.concat(text("files"), F.lit(" files, "), F.format_string("%.1f", "avg_rating")).alias("value"),
    )
    return header.unionByName(god).unionByName(odd).unionByName(ask).unionByName(mod)


def graph_payload(nodes: DataFrame) -> DataFrame:
    """Per-node payload of a graph view."""
    return nodes.select("id", "label", "rating", "loc", "complexity", "imports", "errors", "warnings")
