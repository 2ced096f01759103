"""Path expressions: labels, languages, modules, distances and glob translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "tsx",
    ".jsx": "jsx",
    ".js": "typescript",
    ".cs": "csharp",
}

# Leading folders that do not name a module on their own (wide and narrow list).
MODULE_PREFIXES = ("src", "lib", "app", "packages", "modules", "source")
MODULE_PREFIXES_NARROW = ("src", "lib", "app")

GLOB_DIALECTS = ("scan", "hook", "dashboard", "ignore")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Last extension with its dot; empty for none and for dot-files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def language_of(path: Column | str) -> Column:
    """Language of a supported file, null for any other file."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, extension(path))


def language_group(path: Column | str) -> Column:
    """Configuration group of a file: csharp, typescript or null."""
    ext = extension(path)
    return F.when(ext == ".cs", "csharp").when(ext.isin(".ts", ".tsx", ".jsx", ".js"), "typescript")


def segments(path: Column | str) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda x: x != "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share (zip_with pads the shorter one with nulls)."""
    first_diff = F.array_position(F.zip_with(a, b, lambda x, y: x == y), F.lit(False))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(first_diff == 0, shorter).otherwise(first_diff - 1).cast("int")


def relative_path(root: Column | str, path: Column | str) -> Column:
    """``path`` seen from folder ``root``, with ``..`` steps where it lies outside."""
    r, p = segments(root), segments(path)
    shared = common_prefix_length(r, p)
    ups = F.array_repeat(F.lit(".."), F.size(r) - shared)
    rest = F.slice(p, shared + 1, F.size(p))
    inside = F.startswith(_col(path), F.concat(_col(root), F.lit("/")))
    return F.when(inside, F.substring(_col(path), F.length(_col(root)) + 2, F.length(_col(path)))).otherwise(
        F.array_join(F.concat(ups, rest), "/")
    )


def module_of(path: Column | str, root: Column | str | None = None, prefixes=MODULE_PREFIXES) -> Column:
    """Top-level module of a file; pass ``root=None`` when the path is already relative."""
    parts = segments(_col(path) if root is None else relative_path(root, path))
    first = F.try_element_at(parts, F.lit(1))
    return (
        F.when(F.size(parts) <= 1, "(root)")
        .when(first.isin(*prefixes) & (F.size(parts) > 2), F.try_element_at(parts, F.lit(2)))
        .otherwise(first)
    )


def directory_distance(a: Column | str, b: Column | str) -> Column:
    """Folder steps between two files, up to their common ancestor and down again."""
    x, y = F.split(_col(a), "/"), F.split(_col(b), "/")
    return F.size(x) + F.size(y) - 2 - 2 * common_prefix_length(x, y)


def glob_to_regex(pattern: Column | str, dialect: str = "scan") -> Column:
    """Translate a glob column to a Java regex in one of the four dialects.

    ``?`` is a wildcard only in the ignore dialect; the others keep it as a regex quantifier.
    """
    if dialect not in GLOB_DIALECTS:
        raise ValueError(f"unknown glob dialect: {dialect}")
    star2 = "\u0001"
    p = F.regexp_replace(_col(pattern), r"[.+^${}()|\[\]\\]", r"\\$0")
    p = F.replace(p, F.lit("**"), F.lit(star2))
    p = F.replace(p, F.lit("*"), F.lit("[^/]*"))
    if dialect == "hook":
        p = F.regexp_replace(p, f"^{star2}/", "(?:.*/)?")
    p = F.replace(p, F.lit(star2), F.lit(".*"))
    if dialect == "ignore":
        return F.concat(F.lit("^"), F.replace(p, F.lit("?"), F.lit("[^/]")), F.lit("(?:/.*)?$"))
    if dialect == "scan":
        return F.concat(F.lit("(?i)(?:^|/)"), p, F.lit("$"))
    return F.concat(F.lit("(?i)"), p)


def fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    folded = F.aggregate(
        segments(path),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def dirname(path: Column | str) -> Column:
    p = _col(path)
    return F.substring(p, 1, F.length(p) - F.length(basename(p)) - 1)


def tail_key(path: Column | str, n: Column | int) -> Column:
    """Last ``n`` segments of a path, joined."""
    parts = F.split(_col(path), "/")
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")
