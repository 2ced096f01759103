"""Lookups between files: import resolution, coverage matching, test pairing, file context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .traverse import FRAGILE

# Suffixes tried on a relative import, in order.
IMPORT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
RELATION_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
# Folders below the root that repeat its tree for tests, in order.
PARALLEL_TREES = ["tests", "test", "__tests__"]
# What may follow the stem of a test file, and its usual extensions, in order.
TEST_SUFFIXES = (".test", ".spec")
CS_SUFFIXES = ("Test", "Tests", ".Test", ".Tests")
TEST_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def resolve_imports(imports: DataFrame, listing: DataFrame, suffixes=IMPORT_SUFFIXES, keep_unresolved: bool = True) -> DataFrame:
    """Turn relative specifiers into file paths: the first suffix that names a listed file.

    ``imports``: (source, spec); ``listing``: (path). Package names stay as they are; a relative
    import of an unknown file keeps its folded path. Distinct (folder, spec) pairs are resolved
    once, however many files repeat them.
    """
    rel = F.startswith("spec", F.lit("."))
    base = F.when(rel, P.fold_dots(F.concat(P.dirname("source"), F.lit("/"), F.col("spec"))))
    i = imports.withColumn("base", base)
    tried = i.filter(rel).select("base").distinct().select(
        "base", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in suffixes])).alias("priority", "path")
    )
    found = tried.join(listing.select("path").distinct(), "path").groupBy("base").agg(F.min_by("path", "priority").alias("resolved"))
    out = i.join(found, "base", "left")
    if not keep_unresolved:
        out = out.filter("resolved IS NOT NULL")
    return out.withColumn("target", F.coalesce("resolved", "base", "spec")).withColumn(
        "is_known", F.col("resolved").isNotNull()
    ).drop("base", "resolved")


def match_coverage(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """Coverage entry of each file: the same path, else the first entry with the same last segments.

    ``coverage``: (cov_path, seq, ...). Up to three last segments are compared, fewer when one of
    the paths is shorter. Entries are first reduced to one per key, so equal base names never form
    pairs; a match inside a base name is not made.
    """
    segs = lambda c: F.size(F.split(c, "/"))
    cov = coverage.select("cov_path", "seq", F.least(segs("cov_path"), F.lit(3)).alias("nc"))
    tails = cov.select(
        "cov_path", "seq", "nc", F.explode(F.sequence(F.lit(1), F.col("nc"))).alias("len")
    ).withColumn("key", P.tail_key("cov_path", F.col("len")))
    first = tails.groupBy("nc", "len", "key").agg(F.min(F.struct("seq", "cov_path")).alias("hit"))
    f = files.select("path").distinct()
    exact = f.join(cov.select(F.col("cov_path").alias("path")).distinct(), "path").withColumn("cov_path", F.col("path"))
    rest = f.join(exact, "path", "left_anti").withColumn("nf", F.least(segs("path"), F.lit(3)))
    probes = rest.select("path", "nf", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("nc")).withColumn(
        "len", F.least("nf", "nc")
    ).withColumn("key", P.tail_key("path", F.col("len")))
    near = probes.join(first, ["nc", "len", "key"]).groupBy("path").agg(F.min("hit")["cov_path"].alias("cov_path"))
    return exact.select("path", "cov_path").unionByName(near)


def _with_parts(files: DataFrame) -> DataFrame:
    """Folder, stem, extension and project-relative folder of each path, computed once."""
    f = files.select("path", "root", P.dirname("path").alias("folder"), P.basename("path").alias("name"), P.extension("path").alias("ext"))
    rel = P.relative_path(F.col("root"), F.col("folder"))
    stem = F.substring("name", F.lit(1), F.length("name") - F.length("ext"))
    return f.withColumn("stem", stem).withColumn("side", F.when(F.col("folder") == F.col("root"), "").otherwise(F.concat(F.lit("/"), rel)))


def _listed_names(listing: DataFrame) -> DataFrame:
    """(path, key, suffix, end): every way to read a listed path as key + suffix + extension, at most 14."""
    name = P.basename("path")
    ends = F.array(F.lit(""), F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))))
    suffixes = F.array(*[F.lit(s) for s in ("", *TEST_SUFFIXES, *CS_SUFFIXES)])
    read = listing.select("path", name.alias("name"), F.explode(F.array_compact(ends)).alias("end")).withColumn("suffix", F.explode(suffixes))
    tail = F.concat("suffix", "end")
    read = read.filter(F.endswith("name", tail))
    return read.select("path", F.substring("path", F.lit(1), F.length("path") - F.length(tail)).alias("key"), "suffix", "end")


def _preference():
    """Rank of a test file by place, suffix and extension; null where the names do not fit.

    Beside the file come .test and .spec, then the names of .cs tests, then the other places; the file's own extension
    comes before the usual ones.
    """
    place, suffix, end = F.col("place"), F.col("suffix"), F.col("end")
    usual = F.array_position(F.array(*[F.lit(e) for e in TEST_EXTENSIONS]), end)
    n_ends = 1 + len(TEST_EXTENSIONS)
    at = F.when(end == F.col("ext"), 0).when(usual > 0, usual.cast("int"))
    index = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), suffix).cast("int") - 1
    beside, cs, other = index(TEST_SUFFIXES), index(CS_SUFFIXES), index(("", *TEST_SUFFIXES))
    n_beside = len(TEST_SUFFIXES) * n_ends
    return (
        F.when((place == 0) & (beside >= 0), beside * n_ends + at)
        .when((place == 0) & (cs >= 0), F.when((F.col("ext") == ".cs") & (end == ".cs"), n_beside + cs))
        .when((place > 0) & (other >= 0), n_beside + len(CS_SUFFIXES) + ((place - 1) * (1 + len(TEST_SUFFIXES)) + other) * n_ends + at)
    )


def pair_tests(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Test file of each source file, null where none exists; ``files``: (path, root).

    A file has one row for each place that may hold its tests, a listed path one for each way to read its name: neither
    the rows nor the plan grow with the number of names. Both sides are sorted, as their size on disk says little about them.
    """
    folder = F.col("folder")
    places = [folder, F.concat(folder, F.lit("/__tests__")), *[F.concat("root", F.lit(f"/{d}"), "side") for d in PARALLEL_TREES]]
    sought = _with_parts(files).select("path", "stem", "ext", F.posexplode(F.array(*places)).alias("place", "at"))
    sought = sought.select("path", "ext", "place", F.concat("at", F.lit("/"), "stem").alias("key"))
    named = _listed_names(listing.select("path").distinct()).withColumnRenamed("path", "candidate")
    hit = sought.hint("merge").join(named, "key").withColumn("priority", _preference()).filter("priority IS NOT NULL")
    best = hit.groupBy("path").agg(F.min_by("candidate", "priority").alias("test_path"))
    return files.select("path").distinct().hint("merge").join(best, "path", "left")


def stale_files(analyses: DataFrame, listing: DataFrame) -> DataFrame:
    """Analysed files that no longer exist."""
    return analyses.join(listing.select("path"), "path", "left_anti")


def files_to_scan(listing: DataFrame, analyses: DataFrame, force: bool = False) -> DataFrame:
    """Listed files without an analysis (all of them with ``force``), each under its first root."""
    new = listing if force else listing.join(analyses.select("path"), "path", "left_anti")
    return new.groupBy("path").agg(F.min("root").alias("root"))


def file_links(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Imports and dependents of files as rows: (path, kind, other, type, rating).

    Links stay rows, so a file with very many dependents is never one cell.
    """
    f = files.select("path").distinct()
    out = edges.select(F.col("source").alias("path"), F.lit("import").alias("kind"), F.col("target").alias("other"), "type")
    back = edges.select(F.col("target").alias("path"), F.lit("dependent").alias("kind"), F.col("source").alias("other"), "type")
    r = nodes.select(F.col("id").alias("other"), "rating")
    return out.unionAll(back).join(f, "path", "left_semi").join(r, "other", "left").select("path", "kind", "other", "type", "rating")


def _link_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    weak = nodes.filter(F.col("rating") < FRAGILE).select(F.col("id").alias("source"), F.lit(1).alias("weak"))
    imports = edges.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("imports"))
    dependents = (
        edges.join(weak, "source", "left")
        .groupBy(F.col("target").alias("path"))
        .agg(F.count(F.lit(1)).alias("dependents"), F.count("weak").alias("fragile_dependents"))
    )
    return imports.join(dependents, "path", "full_outer")


def file_summaries(edges: DataFrame, nodes: DataFrame, violations: DataFrame, top: int | None = 5) -> DataFrame:
    """Summary of every file: rating, link counts, severity counts and its first violations (None: all of them)."""
    v = violations.groupBy("path").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")]
    )
    order = F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("severity"))
    w = Window.partitionBy("path").orderBy(order, "type", "line")
    first = (
        violations.withColumn("rn", F.row_number().over(w))
        .filter(F.lit(True) if top is None else F.col("rn") <= top)
        .groupBy("path")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "type", "severity", F.col("line").cast("string")).alias("t")))),
                    lambda x: x["t"],
                ),
                ", ",
            ).alias("top_violations")
        )
    )
    n = nodes.select(F.col("id").alias("path"), "rating", "loc", "complexity")
    out = n.join(_link_counts(edges, nodes), "path", "left").join(v, "path", "left").join(first, "path", "left")
    return out.fillna(0, ["imports", "dependents", "fragile_dependents", "error", "warning", "info"])


def file_context(edges: DataFrame, nodes: DataFrame, breakdown: DataFrame, cycles: DataFrame, trend: DataFrame) -> DataFrame:
    """Context of every file: links, cycle membership, rating deductions and trend.

    ``breakdown``: (path, deductions text), ``cycles``: (path, component, size), ``trend``: (path, direction).
    """
    n = nodes.select(F.col("id").alias("path"), "rating")
    return (
        n.join(_link_counts(edges, nodes), "path", "left")
        .fillna(0, ["imports", "dependents", "fragile_dependents"])
        .join(cycles.select("path", F.col("size").alias("cycle_size")), "path", "left")
        .fillna(0, ["cycle_size"])
        .join(breakdown.select("path", "deductions"), "path", "left")
        .join(trend.select("path", "direction"), "path", "left")
    )
