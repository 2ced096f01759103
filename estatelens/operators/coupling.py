"""Unexpected cross-module edges, suggested questions, module roll-ups and node explanations.

The texts of messages, labels and questions here are fixed values: results must hold them word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rating as R
from .centrality import centrality_rank, degree_centrality


def _crossing(edges: DataFrame, nodes: DataFrame, prefixes) -> tuple[DataFrame, DataFrame]:
    """Distinct edges between modules with both modules, and the number of entries of each pair of modules.

    The joins with the files also drop edges of unknown ends. Entries are counted as duplicates go, where the last join
    left them, so both tables read the same shuffled edges.
    """
    n = nodes.select("repo", "id", P.module_of("id", F.col("repo"), prefixes).alias("module"))
    e = (
        edges.select("source", "target")
        .join(n.select("repo", F.col("id").alias("source"), F.col("module").alias("source_module")), "source")
        .join(n.select(F.col("id").alias("target"), F.col("module").alias("target_module")), "target")
        .filter("source_module <> target_module")
        .groupBy("repo", "source", "target", "source_module", "target_module")
        .agg(F.count(F.lit(1)).alias("_entries"))
    )
    return e, e.groupBy(*_PAIR).agg(F.sum("_entries").alias("pair_count"))


_PAIR = ["repo", "source_module", "target_module"]


def _scored(e: DataFrame, pairs: DataFrame, mode: str) -> DataFrame:
    # One row per module pair: far smaller than the edges, so Spark may broadcast it by its size.
    e = e.join(pairs, _PAIR)
    dist = P.directory_distance("source", "target")
    count = F.col("pair_count")
    score = (dist if mode == "distance" else F.lit(1.0)) / F.log(count + 1)
    plural = F.when(count != 1, "s").otherwise("")
    return e.select(
        "repo",
        "source",
        "target",
        "source_module",
        "target_module",
        count,
        dist.alias("distance"),
        score.alias("score"),
        F.concat(
            "source_module", F.lit(" → "), "target_module", F.lit(" ("), count.cast("string"), F.lit(" cross-edge"), plural,
            F.lit(", distance "), dist.cast("string"), F.lit(")"),
        ).alias("explanation"),
    )


def cross_module_edges(edges: DataFrame, nodes: DataFrame, prefixes=P.MODULE_PREFIXES, mode: str = "distance") -> DataFrame:
    """Every cross-module edge with its score, per repository.

    ``mode="distance"``: folder distance / ln(pair count + 1); ``mode="inverse"``: 1 / ln(pair
    count + 1). The pair count is taken before duplicates are removed. Node ``repo`` is the root
    folder of the repository the source file belongs to.
    """
    return _scored(*_crossing(edges, nodes, prefixes), mode)


def surprising(edges: DataFrame, nodes: DataFrame, top: int = 10, prefixes=P.MODULE_PREFIXES, mode: str = "distance") -> DataFrame:
    """The ``top`` most surprising edges of each repository.

    Edges of one pair of modules share its count, so their order needs none: each pair hands on its first ``top``
    before the counts are joined, and the edges are not shuffled by pairs.
    """
    from pyspark.sql import Window

    e, pairs = _crossing(edges, nodes, prefixes)
    order = [F.desc(P.directory_distance("source", "target"))] if mode == "distance" else []
    first = Window.partitionBy(*_PAIR).orderBy(*order, "source", "target")
    e = e.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= top)
    # Scores that differ only in the last bits of the logarithm are ties.
    w = Window.partitionBy("repo").orderBy(F.desc(F.round("score", 9)), "source", "target")
    return _scored(e, pairs, mode).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def module_rollup(nodes: DataFrame, top: int = 8) -> DataFrame:
    """Largest modules of each repository with their mean rating."""
    from pyspark.sql import Window

    m = nodes.groupBy("repo", P.module_of("id", F.col("repo")).alias("module")).agg(
        F.count(F.lit(1)).alias("files"), R.round1(F.avg("rating")).alias("avg_rating")
    )
    w = Window.partitionBy("repo").orderBy(F.desc("files"), "module")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _top(df: DataFrame, n: int, *order, keep: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("repo", "rn", *keep)


def suggested_questions(edges: DataFrame, nodes: DataFrame, max_questions: int = 5) -> DataFrame:
    """Questions each repository's graph can answer, in a fixed order of templates."""
    rank = degree_centrality(edges, nodes)
    god = _top(rank, 2, F.desc("total_degree"), "path", keep=["path"])
    imported = _top(rank, 1, F.desc("in_degree"), F.desc("total_degree"), "path", keep=["path"])
    worst = _top(nodes, 1, "rating", "id", keep=["id", "rating"]).select("repo", F.col("id").alias("worst"), "rating")
    modules = nodes.groupBy("repo").agg(F.count_distinct(P.module_of("id", F.col("repo"))).alias("modules"))
    first = god.filter("rn = 1").select("repo", F.col("path").alias("god"))
    rel = lambda c: P.relative_path(F.col("repo"), F.col(c))
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])

    def rows(df, ord_, typ, tool, file, text):
        return df.select(
            "repo", F.lit(ord_).alias("ord") if isinstance(ord_, int) else ord_.alias("ord"), F.lit(typ).alias("type"),
            F.lit(tool).alias("tool"), F.col(file).alias("file"), text.alias("question"),
        )

    parts = [
        rows(god, F.col("rn"), "impact", "get_impact_set", "path", say("What would break if ", rel("path"), " changed?")),
        rows(imported, 3, "dependency", "get_impact_set", "path", say("What depends on ", rel("path"), "?")),
        rows(
            first.join(worst, "repo").filter("god <> worst"), 4, "path", "trace_path", "god",
            say("How does ", rel("god"), " connect to ", rel("worst"), " (lowest-rated file)?"),
        ),
        rows(
            worst.filter("rating < 7"), 5, "health", "suggest_refactoring", "worst",
            say("How unhealthy is ", rel("worst"), " and what should be fixed first?"),
        ),
        rows(
            first.join(modules.filter("modules > 2"), "repo"), 6, "explanation", "explain_node", "god",
            say("Which modules does ", rel("god"), " bridge, and is that coupling intentional?"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, max_questions, "ord", keep=["type", "tool", "file", "question"]).withColumnRenamed("rn", "ord")


def prompt_questions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shorter question list of the interactive prompt: three hubs, a path and the worst file."""
    rank = degree_centrality(edges, nodes)
    god = _top(rank, 3, F.desc("total_degree"), "path", keep=["path"])
    worst = _top(nodes, 1, "rating", "id", keep=["id", "rating"]).select("repo", F.col("id").alias("worst"), "rating")
    first = god.filter("rn = 1").select("repo", F.col("path").alias("god"))
    q = lambda c: F.concat(F.lit('"'), P.relative_path(F.col("repo"), F.col(c)), F.lit('"'))
    return (
        god.select("repo", F.col("rn").alias("ord"), F.concat(F.lit("What would break if "), q("path"), F.lit(" changed?")).alias("question"))
        .unionByName(
            first.join(worst, "repo").filter("god <> worst").select(
                "repo", F.lit(4).alias("ord"),
                F.concat(F.lit("How does "), q("god"), F.lit(" connect to "), q("worst"), F.lit(" (worst-rated file)?")).alias("question"),
            )
        )
        .unionByName(
            worst.filter("rating < 7").select(
                "repo", F.lit(5).alias("ord"),
                F.concat(F.lit("What's wrong with "), q("worst"), F.lit(" (rating "), R.js_num(F.col("rating")), F.lit("/10)?")).alias("question"),
            )
        )
    )


def explain_nodes(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rank, degrees, depth-2 impact, role and surprising edges of each given file."""
    from .traverse import impact_set

    ranked = centrality_rank(degree_centrality(edges, nodes), files)
    hit = impact_set(edges, nodes, files.select(F.col("path").alias("root"))).groupBy(F.col("root").alias("path")).agg(
        F.count(F.lit(1)).alias("impacted"), F.count_if("fragile").alias("fragile")
    )
    top = surprising(edges, nodes, 10)
    odd = (
        top.select(F.col("source").alias("path"))
        .unionAll(top.filter("source <> target").select(F.col("target").alias("path")))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("surprising"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    role = F.when(F.col("in_degree") > 5, "god node").when(F.col("out_degree") > 10, "highly coupled").otherwise("standard")
    return (
        ranked.join(hit, "path", "left")
        .join(odd, "path", "left")
        .select(
            "path", "rating", F.col("rank").cast("long").alias("rank"), "in_degree", "out_degree", "total_degree",
            zero("impacted"), zero("fragile"), zero("surprising"), role.alias("role"),
        )
    )
