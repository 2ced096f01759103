"""From analyses to a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

TYPE_PREFIX = "__type__:"


def nodes_of(analyses: DataFrame) -> DataFrame:
    """Node projection of an analyses table."""
    return analyses.select(
        "repo",
        F.col("path").alias("id"),
        P.basename("path").alias("label"),
        "language",
        "rating",
        F.greatest(F.lit(1.0), F.col("metrics.linesOfCode") / 100).alias("size"),
        F.col("metrics.linesOfCode").alias("loc"),
        F.col("metrics.cyclomaticComplexity").alias("complexity"),
        F.col("metrics.importCount").alias("imports"),
        F.size("violations").alias("n_violations"),
    )


def dependencies_of(analyses: DataFrame) -> DataFrame:
    """Dependency entries with their order (analysis order, then position in the file)."""
    return analyses.select("repo", "path", "seq", F.posexplode("dependencies").alias("i", "d")).select(
        "repo",
        F.col("d.source").alias("source"),
        "path",
        F.col("d.target").alias("target"),
        F.col("d.type").alias("type"),
        F.col("d.weight").alias("weight"),
        F.struct("seq", "i").alias("pos"),
    )


def type_owners(defined: DataFrame) -> DataFrame:
    """First file that defines each type; input rows are (repo, type_name, path, pos)."""
    return defined.groupBy("repo", "type_name").agg(F.min_by("path", "pos").alias("owner"))


def defined_types(analyses: DataFrame) -> DataFrame:
    return analyses.select("repo", "path", "seq", F.posexplode_outer("definedTypes").alias("i", "type_name")).filter(
        F.col("type_name").isNotNull()
    ).select("repo", "type_name", "path", F.struct("seq", "i").alias("pos"))


def resolve_types(deps: DataFrame, defined: DataFrame) -> DataFrame:
    """Replace ``__type__:Name`` targets by the defining file; unresolved and self references go."""
    owners = type_owners(defined)
    is_ref = F.startswith("target", F.lit(TYPE_PREFIX))
    plain = deps.filter(~is_ref)
    refs = deps.filter(is_ref).withColumn("type_name", F.substring("target", len(TYPE_PREFIX) + 1, 1 << 30))
    resolved = (
        refs.join(owners, ["repo", "type_name"])
        .filter(F.col("owner") != F.col("path"))
        .withColumn("target", F.col("owner"))
        .drop("type_name", "owner")
    )
    return plain.unionByName(resolved.select(*plain.columns))


def known_targets(deps: DataFrame, nodes: DataFrame, both_ends: bool = False) -> DataFrame:
    """Keep edges whose target (and source) is an analysed file."""
    ids = nodes.select(F.col("id").alias("target"))
    out = deps.join(ids, "target", "left_semi")
    if both_ends:
        out = out.join(nodes.select(F.col("id").alias("source")), "source", "left_semi")
    return out


def first_wins(deps: DataFrame) -> DataFrame:
    """One edge per (source, target) with the type and weight of the first entry.

    An aggregate, not a window: entries combine map-side, so a pair with very many entries never
    lands in one task as rows.
    """
    return (
        deps.groupBy("source", "target")
        .agg(F.min_by(F.struct("type", "weight"), "pos").alias("f"))
        .select("source", "target", F.col("f.type").alias("type"), F.col("f.weight").alias("strength"))
    )


def build_graph(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and de-duplicated, resolved edges of an analyses table."""
    nodes = nodes_of(analyses)
    deps = resolve_types(dependencies_of(analyses), defined_types(analyses))
    return nodes, first_wins(known_targets(deps, nodes))
