"""Source-tree scans, LCOV reports and ignore files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..rules import tables as RT
from ..session import materialize

SOURCE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".cs")
# Where a project keeps its coverage report, in order of preference.
LCOV_LOCATIONS = ["coverage/lcov.info", "coverage/lcov-report/lcov.info", "lcov.info", ".coverage/lcov.info"]
IGNORE_FILE = ".graphifyignore"
LISTED = "path string, modificationTime timestamp, length long, is_folder boolean"
#: Bytes of file contents that a task hands over together.
READ_BYTES = 16 << 20


def _opened(root: str):
    """File system of a root, the root's path in it, and what comes before such a path in a full name."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    local = isinstance(files, fs.LocalFileSystem)
    return files, base, "" if local or not root.endswith(base) else root[: len(root) - len(base)], local


def _list_folders(root: str, skip: list[str], dot_dirs: bool):
    """Task that lists folders: their source files, and the folders below them that are not skipped."""

    def run(batches):
        from pyarrow import fs

        files, _, _, local = _opened(root)
        skipped = set(skip)
        for batch in batches:
            for folder in batch["path"]:
                try:
                    entries = files.get_file_info(fs.FileSelector(folder))
                except OSError:  # a folder that cannot be read has no files
                    continue
                rows = []
                for e in entries:
                    if local and os.path.islink(e.path):
                        continue
                    if e.type == fs.FileType.Directory:
                        if not (e.base_name in skipped or (dot_dirs and e.base_name.startswith("."))):
                            rows.append((e.path, None, None, True))
                    elif e.type == fs.FileType.File and e.base_name.endswith(SOURCE_SUFFIXES):
                        rows.append((e.path, e.mtime, e.size, False))
                out = pd.DataFrame(rows, columns=["path", "modificationTime", "length", "is_folder"])
                yield out.astype({"modificationTime": "datetime64[us, UTC]", "length": "Int64"})

    return run


def _read_files(root: str):
    """Task that reads the contents of listed files, a bounded number of bytes at a time."""

    def run(batches):
        files, _, _, _ = _opened(root)
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                try:
                    with files.open_input_stream(row.path) as stream:
                        content = stream.read()
                except FileNotFoundError:  # deleted since it was listed
                    continue
                rows.append((*row, content))
                held += len(content)
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=[*batch.columns, "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[*batch.columns, "content"])

    return run


def _spread(spark: SparkSession, df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt to tasks for work outside Spark, whose cost their bytes do not show."""
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(rows, most)), "path")


def _source_files(spark: SparkSession, root: str, skip: list[str], dot_dirs: bool) -> tuple[DataFrame, int]:
    """Source files below ``root`` and their number: (path, modificationTime, length), paths as the file system has them.

    Tasks list the tree level by level, each level a written table; a skipped folder is never opened, and links are
    not followed.
    """
    _, base, _, _ = _opened(root)
    level, n, paths, total = spark.createDataFrame([(base,)], "path string"), 1, [], 0
    while n:
        found = materialize(_spread(spark, level, n).mapInPandas(_list_folders(root, skip, dot_dirs), LISTED), "listing", where=F.col("is_folder"))
        n, total = found.hits, total + found.rows - found.hits
        level = found.df.filter("is_folder").select("path")
        paths.append(found.path)
    listed = spark.read.schema(LISTED).parquet(*paths)
    return listed.filter("NOT is_folder").drop("is_folder"), total


def scan_tree(spark: SparkSession, root: str, listing_only: bool = False) -> DataFrame:
    """Supported source files below ``root``: path, language, mtime, size, content and sha1.

    ``root`` is an absolute path or a URI. Skips build and dot folders. With ``listing_only`` the contents are not
    read.
    """
    root = root.rstrip("/")
    out, n = _source_files(spark, root, RT.SCAN_SKIP_DIRS, True)
    path = F.concat(F.lit(_opened(root)[2]), "path")
    cols = [F.lit(root).alias("root"), path.alias("path"), P.language_of("path").alias("language"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    if listing_only:
        return out.select(*cols)
    read = _spread(spark, out, n).mapInPandas(_read_files(root), "path string, modificationTime timestamp, length long, content binary")
    return read.select(*cols, F.decode("content", "UTF-8").alias("content"), F.sha1("content").alias("file_hash"))


def health_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Files of the health report: another skip list (dot folders stay); with ``max_files`` only the first paths."""
    root = root.rstrip("/")
    found, _ = _source_files(spark, root, RT.HEALTH_SKIP_DIRS, False)
    found = found.select(F.concat(F.lit(_opened(root)[2]), "path").alias("path"))
    return found if max_files is None else found.orderBy("path").limit(max_files)


def parse_lcov(records: DataFrame) -> dict[str, DataFrame]:
    """Coverage tables of LCOV records: ``records`` has (root, seq, record).

    Returns ``lines`` (path, line, hits: the last entry of a line counts) and ``declared``
    (path, seq, lf, lh). Relative source paths are taken below ``root``; a path listed twice keeps
    its last record.
    """
    sf = F.trim(F.regexp_extract("record", r"(?m)^\s*SF:(.+)$", 1))
    r = records.withColumn("sf", sf).filter("sf <> ''")
    absolute = F.startswith("sf", F.lit("/"))
    full = F.when(absolute, F.col("sf")).otherwise(P.fold_dots(F.concat("root", F.lit("/"), F.col("sf"))))
    r = r.withColumn("path", full)
    last = r.groupBy("path").agg(F.max("seq").alias("seq"))
    r = r.join(last, ["path", "seq"])
    da = F.regexp_extract_all("record", F.lit(r"(?m)^\s*DA:(\d+,\d+)"), 1)
    entries = r.select("path", F.posexplode(da).alias("i", "e")).select(
        "path", "i", F.substring_index("e", ",", 1).cast("int").alias("line"), F.substring_index("e", ",", -1).cast("long").alias("hits")
    )
    lines = entries.groupBy("path", "line").agg(F.max_by("hits", "i").alias("hits"))
    number = lambda key: F.coalesce(F.try_element_at(F.regexp_extract_all("record", F.lit(rf"(?m)^\s*{key}:(\d+)"), 1), F.lit(-1)).cast("long"), F.lit(0))
    return {"lines": lines, "declared": r.select("path", "seq", number("LF").alias("lf"), number("LH").alias("lh"))}


def read_lcov(spark: SparkSession, paths: list[str] | str, root: str) -> DataFrame:
    """Split LCOV files into records (root, seq, record); ``seq`` orders them by file and place in the file."""
    raw = spark.read.option("lineSep", "end_of_record").text(paths)
    return raw.select(F.lit(root).alias("root"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("seq"), F.col("value").alias("record"))


def pick_reports(found: DataFrame) -> DataFrame:
    """Coverage report of each project: the first conventional location that exists.

    ``found``: (project, path) of existing files.
    """
    rel = P.relative_path(F.col("project"), F.col("path"))
    place = F.array_position(F.array(*[F.lit(x) for x in LCOV_LOCATIONS]), rel)
    w = Window.partitionBy("project").orderBy("place")
    return found.withColumn("place", place).filter("place > 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("project", "path")


def parse_ignore(texts: DataFrame) -> DataFrame:
    """Ordered rules of ignore files: ``texts`` has (repo, content).

    Output: repo, ord, pattern, negate, anchored, regex.
    """
    lines = texts.select("repo", F.posexplode(F.split("content", "\n", -1)).alias("i", "raw"))
    strip = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    lines = lines.withColumn("line", strip(F.col("raw"))).filter("line <> '' AND NOT startswith(line, '#')")
    negate = F.startswith("line", F.lit("!"))
    body = F.when(negate, strip(F.substring("line", 2, 1 << 30))).otherwise(F.col("line"))
    out = lines.withColumn("negate", negate).withColumn("body", body)
    out = out.withColumn("anchored", F.contains("body", F.lit("/"))).withColumn("pattern", F.regexp_replace("body", "/$", ""))
    return out.select(
        "repo", F.col("i").alias("ord"), "pattern", "negate", "anchored", P.glob_to_regex("pattern", "ignore").alias("regex")
    )


def read_ignore(spark: SparkSession, root: str) -> DataFrame:
    """Rules of the ignore file at a repository root; none when the file is missing."""
    root = root.rstrip("/")
    # Spark's readers pass over names that begin with a dot, so a task reads the file by its name.
    name = spark.createDataFrame([(f"{_opened(root)[1]}/{IGNORE_FILE}",)], "path string")
    raw = name.mapInPandas(_read_files(root), "path string, content binary")
    return parse_ignore(raw.select(F.lit(root).alias("repo"), F.decode("content", "UTF-8").alias("content")))
