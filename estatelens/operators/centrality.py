"""Degree and betweenness centrality, adjacency lists and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Written, materialize
from .traverse import NumberedGraph, _together, number_graph
from .windows import position_in_group

ADJACENCY_CHUNK = 1000


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In, out and total degree per node, zero where isolated. Parallel edges count."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    deg = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        nodes.select("repo", "id", "label", "rating")
        .join(deg, "id", "left")
        .select(
            "repo",
            F.col("id").alias("path"),
            "label",
            zero("in_degree").alias("in_degree"),
            zero("out_degree").alias("out_degree"),
            (zero("in_degree") + zero("out_degree")).alias("total_degree"),
            "rating",
        )
    )


def god_nodes(edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most connected files."""
    ranked = degree_centrality(edges, nodes).orderBy(F.desc("total_degree"), "path")
    return ranked.limit(limit)


def most_connected(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Files by number of incident edges, counted over edge endpoints only."""
    ends = edges.select(F.col("source").alias("path")).unionAll(edges.select(F.col("target").alias("path")))
    return ends.groupBy("path").agg(F.count(F.lit(1)).alias("connections")).orderBy(F.desc("connections"), "path").limit(limit)


def centrality_rank(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """1-based position of files in the ranking by (total degree, path).

    The files above come from the degree histogram (one row per distinct degree), the place among
    equals from ``position_in_group``, so no window spans a whole repository.
    """
    hist = ranked.groupBy("repo", "total_degree").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("repo").orderBy(F.desc("total_degree")).rowsBetween(Window.unboundedPreceding, -1)
    above = hist.select("repo", "total_degree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    placed = position_in_group(ranked, ["repo", "total_degree"], "path", "place")
    return (
        placed.join(above, ["repo", "total_degree"])
        .withColumn("rank", F.col("above") + F.col("place"))
        .drop("above", "place")
        .join(files.select("path"), "path", "left_semi")
    )


def adjacency(edges: DataFrame, reverse: bool = False, chunk: int = ADJACENCY_CHUNK) -> DataFrame:
    """Adjacency lists as (path, chunk_no, degree, neighbours).

    A list is cut into chunks of about ``chunk`` entries (by hash of the neighbour), so the list of
    a god node is spread over many rows and tasks instead of being collected into one.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    e = edges.select(F.col(a).alias("path"), F.col(b).alias("neighbour"))
    degree = e.groupBy("path").agg(F.count(F.lit(1)).alias("degree"))
    chunks = F.ceil(F.col("degree") / chunk)
    return (
        e.join(degree, "path")
        .withColumn("chunk_no", F.pmod(F.xxhash64("neighbour"), chunks))
        .groupBy("path", "chunk_no", "degree")
        .agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))
    )


def neighbourhood(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges touching each given file: (file, source, target, type, strength)."""
    f = files.select("path").distinct()
    out = edges.join(f.select(F.col("path").alias("source")), "source").withColumn("file", F.col("source"))
    back = edges.join(f.select(F.col("path").alias("target")), "target").withColumn("file", F.col("target"))
    cols = ["file", "source", "target", "type", "strength"]
    return out.select(*cols).unionByName(back.filter("source <> target").select(*cols))


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Directed, unweighted betweenness (Brandes), for all sources at once.

    Forward: one level per round holds (source, node, sigma). Backward: from the deepest level up,
    each node hands its dependency to its predecessors. State is one row per reachable
    (source, node) pair; pass ``sources`` (column id) to estimate from a sample, scaled by
    n / |sources|, or by a column ``weight`` of it. Parallel edges count as separate paths. Normalised per
    repository graph.
    """
    graph = number_graph(edges, nodes, keep_parallel=True)
    weighted = sources is not None and "weight" in sources.columns
    ids = nodes.select("id") if sources is None else sources.select("id", *(["weight"] if weighted else [])).dropDuplicates(["id"])
    picked = materialize(graph.encode(ids, "id", "root"), "sources")
    levels = _count_paths(graph, picked.df)
    gained: Written | None = None
    partial: list[Written] = []
    for depth in range(len(levels) - 1, 0, -1):
        # A frontier that is written first has a known size: a small one does not have the links shuffled.
        cur = levels[depth].df.withColumn("delta", F.lit(0.0)) if gained is None else gained.df
        prev = levels[depth - 1].df
        to = prev.select("root", F.col("node").alias("pred"), F.col("sigma").alias("psigma"))
        up = (
            graph.dependents(cur, "node", "pred")
            .join(to, ["root", "pred"])
            .groupBy("root", F.col("pred").alias("node"))
            .agg(F.sum(F.col("psigma") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        )
        if depth > 1:
            full = prev.join(up, ["root", "node"], "left").select("root", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
            gained = materialize(full, "delta")
            partial.append(gained)
    total = None
    if partial:
        total = _together(partial)[0].filter("delta > 0")
        if weighted:
            total = total.join(picked.df, "root").withColumn("delta", F.col("delta") * F.col("weight"))
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    norm = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(F.lit(1))
    base = nodes.select("repo", "id").join(n, "repo")
    if total is None:
        scored = base.withColumn("betweenness", F.lit(0.0))
    else:
        sums = graph.decode(total.groupBy("node").agg(F.sum("delta").alias("betweenness")), "node", "id")
        if sources is not None and not weighted:
            sums = sums.withColumn("betweenness", F.col("betweenness") * graph.nodes.rows / F.lit(max(picked.rows, 1)))
        scored = base.join(sums, "id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    return scored.select(
        "repo", F.col("id").alias("path"), "betweenness", (F.col("betweenness") / norm).alias("normalized_betweenness")
    )


def sampled_sources(nodes: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """Sources for an estimate of betweenness within a stated error: (id, weight).

    Of a repository of n files, k = ceil((n / (n - 1))^2 ln(2n / delta) / (2 epsilon^2)) files, or all if that is
    fewer, are drawn by the md5 of their id; each stands for n / k. A source adds at most n / (n - 1) to a mean
    of normalised scores, so by Hoeffding's inequality all files of the repository are within ``epsilon`` of their
    normalised betweenness with probability 1 - ``delta``, as long as its edges stay inside it. k grows with the
    logarithm of n, so the rows of a run grow as n log n, not as n squared.
    """
    n = F.col("n").cast("double")
    most = F.ceil(F.pow(n / F.greatest(n - 1, F.lit(1.0)), 2) * F.log(2 * n / delta) / (2 * epsilon * epsilon))
    sizes = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.least(F.col("n"), most))
    placed = position_in_group(nodes.select("repo", "id", F.md5(F.col("id").cast("binary")).alias("h")), ["repo"], ["h", "id"], "place")
    drawn = placed.join(sizes, "repo").where("place <= k")
    return drawn.select("id", (F.col("n") / F.col("k")).alias("weight"))


def sampled_betweenness(edges: DataFrame, nodes: DataFrame, epsilon: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Betweenness estimated from :func:`sampled_sources`; exact in repositories that are sampled whole."""
    return betweenness(edges, nodes, sampled_sources(nodes, epsilon, delta))


def _count_paths(graph: NumberedGraph, sources: DataFrame) -> list[Written]:
    """Breadth-first levels with the number of shortest paths; level 0 is the sources themselves."""
    start = sources.select("root", F.col("root").alias("node"), F.lit(1.0).alias("sigma"))
    levels = [materialize(start, "sigma")]
    while True:
        nxt = (
            graph.dependencies(levels[-1].df.withColumnRenamed("node", "at"), "at", "node")
            .groupBy("root", "node")
            .agg(F.sum("sigma").alias("sigma"))
        )
        spark = nxt.sparkSession
        old = spark.read.schema(levels[0].df.schema).parquet(*[x.path for x in levels])
        nxt = nxt.join(old.select("root", "node"), ["root", "node"], "left_anti")
        level = materialize(nxt.select("root", "node", "sigma"), "sigma")
        if level.rows == 0:
            level.drop()
            return levels
        levels.append(level)
