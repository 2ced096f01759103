"""Corpus-wide lexical scans with Spark's own regex functions. Texts are always read whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..rules import tables as RT
from .filters import is_test_path
from .joins import RELATION_SUFFIXES, resolve_imports


def strip(text: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\r\n\f\u000b"))


def explode_lines(corpus: DataFrame) -> DataFrame:
    """Lines with 1-based numbers; the empty line after a final newline counts."""
    return corpus.select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).select(
        "path", "language", (F.col("i") + 1).alias("line"), "text"
    )


def marker_violations(corpus: DataFrame) -> DataFrame:
    """TODO, debt and stub markers, at most one per line, first rule wins.

    ``language`` picks the stub rule; ``snippet`` (any language) uses both.
    """
    ts, cs = RT.STUB_PATTERNS["typescript"], RT.STUB_PATTERNS["csharp"]
    lines = explode_lines(corpus)
    hit = None
    text = F.col("text")
    for typ, severity, pattern, fix in RT.MARKER_RULES:
        found = F.struct(
            F.lit(typ).alias("type"), F.lit(severity).alias("severity"), F.lit(fix).alias("fix"),
            F.upper(F.regexp_extract(text, pattern, 1)).alias("marker"), F.regexp_substr(text, F.lit(pattern)).alias("match"),
        )
        cond = F.rlike(text, F.lit(pattern))
        hit = F.when(cond, found) if hit is None else hit.when(cond, found)
    lang = F.col("language")
    stub = F.when(lang == "csharp", F.regexp_substr(text, F.lit(cs))).when(
        lang == "snippet", F.coalesce(F.regexp_substr(text, F.lit(ts)), F.regexp_substr(text, F.lit(cs)))
    ).otherwise(F.regexp_substr(text, F.lit(ts)))
    found = F.struct(
        F.lit("unimplemented_stub").alias("type"), F.lit("error").alias("severity"), F.lit(RT.STUB_FIX).alias("fix"),
        F.lit("").alias("marker"), stub.alias("match"),
    )
    hit = hit.when(stub.isNotNull(), found)
    out = lines.withColumn("h", hit).filter("h IS NOT NULL")
    n = F.col("line").cast("string")
    message = (
        F.when(F.col("h.type") == "todo_placeholder", F.concat("h.marker", F.lit(" marker at line "), n, F.lit(" — resolve before merging")))
        .when(F.col("h.type") == "tech_debt_marker", F.concat("h.marker", F.lit(" marker at line "), n, F.lit(" — track in your issue tracker")))
        .when(
            (F.col("h.type") == "unimplemented_stub") & (lang == "csharp"),
            F.concat(F.lit("Unimplemented stub at line "), n, F.lit(" — NotImplementedException will throw at runtime")),
        )
        .otherwise(F.concat(F.lit("Unimplemented stub at line "), n, F.lit(" — will throw at runtime")))
    )
    return out.select(
        "path", "line", F.col("h.type").alias("type"), F.col("h.severity").alias("severity"), message.alias("message"),
        F.position(F.col("h.match"), text).alias("column"),
        F.length("h.match").alias("length"), F.col("h.fix").alias("fix"),
    )


def scan_rules(corpus: DataFrame, rules: list[dict]) -> DataFrame:
    """Apply a rule table to a corpus: one row per rule hit.

    Each rule is a dict with type, severity, pattern and scope (``line`` or ``file``). Rules become
    expressions of one pass over the text, so rows are not multiplied by the number of rules.
    ``line`` rules report each matching line with its number of matches; ``file`` rules report the
    file with the total.
    """
    line_rules = [r for r in rules if r["scope"] == "line"]
    file_rules = [r for r in rules if r["scope"] == "file"]

    def hits(rs, text):
        items = [
            F.struct(
                F.lit(r["type"]).alias("type"), F.lit(r["severity"]).alias("severity"),
                F.regexp_count(text, F.lit(X.ascii_words(r["pattern"]))).alias("matches"),
            )
            for r in rs
        ]
        return F.filter(F.array(*items), lambda x: x["matches"] > 0)

    parts = []
    if line_rules:
        lines = explode_lines(corpus).select("path", "line", F.explode(hits(line_rules, F.col("text"))).alias("h"))
        parts.append(lines.select("path", "line", "h.*"))
    if file_rules:
        whole = corpus.select("path", F.lit(None).cast("int").alias("line"), F.explode(hits(file_rules, F.col("content"))).alias("h"))
        parts.append(whole.select("path", "line", "h.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Lexical forms of the rules that need a syntax tree in the reference (analyzer / snippet variants).
TYPE_RULES = [
    {"type": "any_type", "severity": "warning", "pattern": r":\s*any\b|\bas\s+any\b|<any>", "scope": "line"},
    {"type": "console_log", "severity": "info", "pattern": r"\bconsole\.log\s*\(", "scope": "line"},
]
SNIPPET_TYPE_RULES = [
    {"type": "any_usage", "severity": "warning", "pattern": r":\s*any\b|\bas\s+any\b|<any>", "scope": "line"},
    {"type": "console_log", "severity": "info", "pattern": r"\bconsole\.\w+\s*\(", "scope": "line"},
]


def extract_imports(corpus: DataFrame) -> DataFrame:
    """Import specifiers of each file in order: (source, i, spec, type)."""
    ts = F.regexp_extract_all("content", F.lit(r"(?:\bfrom\s*|^\s*import\s*|\n\s*import\s*|\brequire\s*\(\s*)['\"]([^'\"\n]+)['\"]"), 1)
    cs = F.regexp_extract_all("content", F.lit(RT.CS_USING), 1)
    specs = F.when(F.col("language") == "csharp", cs).otherwise(ts)
    return corpus.select(F.col("path").alias("source"), F.posexplode(specs).alias("i", "spec")).withColumn("type", F.lit("import"))


def link_targets(pages: DataFrame, pattern: str = 'href="([^"]+)"') -> DataFrame:
    """Reference targets of marked-up texts: (source, target)."""
    return pages.select("source", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("target"))


def lexical_metrics(corpus: DataFrame) -> DataFrame:
    """Lines, methods, classes, complexity and imports of each file."""
    c = F.col("content")
    count = lambda p: F.regexp_count(c, F.lit(p))
    cs = F.col("language") == "csharp"
    ts_methods = count(r"\bfunction\b\s*\*?\s*\w*\s*\(|=>|(?m)^\s*(?:(?:public|private|protected|static|async|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|constructor\b)\w+\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{")
    ts_branches = count(r"\bif\s*\(|\bwhile\s*\(|\bfor\s*\(|\bcase\b[^:\n]+:|\bcatch\b|\?(?![.?:])[^?:\n]*:")
    return corpus.select(
        "path",
        "language",
        X.line_count(c).alias("loc"),
        F.when(cs, count(RT.CS_METHOD)).otherwise(ts_methods).alias("methods"),
        F.when(cs, count(RT.CS_CLASS)).otherwise(count(r"\bclass\s+\w+")).alias("classes"),
        (F.when(cs, count(RT.CS_COMPLEXITY)).otherwise(ts_branches) + 1).alias("complexity"),
        F.when(cs, count(r"(?m)^using\s+")).otherwise(count(r"(?m)^\s*import\b")).alias("imports"),
    )


def csharp_violations(corpus: DataFrame) -> DataFrame:
    """Type too large, constructor with many parameters, magic number, empty catch.

    One pass over the texts: every pattern runs once a file, and what it finds is spread to rows at the end.
    """
    c = F.col("content")
    args = F.regexp_extract_all(c, F.lit(RT.CS_CONSTRUCTOR), 1)
    params = F.transform(args, lambda a: F.size(F.filter(F.split(a, ","), lambda p: strip(p) != "")))
    d = corpus.filter("language = 'csharp'").select(
        "path",
        F.regexp_count(c, F.lit(RT.CS_GOD_METHOD_FAST)).alias("methods"),
        F.filter(params, lambda n: n > 5).alias("params"),
        F.regexp_extract_all(c, F.lit(RT.CS_MAGIC_NUMBER_FAST), 1).alias("numbers"),
        F.regexp_count(c, F.lit(RT.CS_EMPTY_CATCH)).alias("silent"),
    )

    def found(type_, severity, occurrences, *message):
        return F.struct(
            F.lit(type_).alias("type"), F.lit(severity).alias("severity"), occurrences.alias("occurrences"), F.concat(*message).alias("message")
        )

    one = F.lit(1)
    god = found(
        "god_class", "warning", one, F.lit("Class has "), F.col("methods").cast("string"),
        F.lit(" methods — consider splitting responsibilities (Single Responsibility Principle)"),
    )
    coupled = lambda n: found(
        "tight_coupling", "warning", one, F.lit("Constructor has "), n.cast("string"),
        F.lit(" parameters — consider using a configuration object or DI container"),
    )
    magic = lambda n: found("magic_number", "info", one, F.lit("Magic number "), n, F.lit(" — extract to a named constant"))
    silent = found("empty_catch", "error", F.col("silent"), F.lit("Empty catch block silently swallows exceptions"))
    rows = F.concat(
        F.array_compact(F.array(F.when(F.col("methods") > 20, god), F.when(F.col("silent") > 0, silent))),
        F.transform("params", coupled),
        F.transform("numbers", magic),
    )
    return d.select("path", F.explode(rows).alias("v")).select("path", "v.*")


def defined_types(corpus: DataFrame) -> DataFrame:
    """Type names a C# file defines, in order of first appearance: (path, type_names)."""
    return corpus.filter("language = 'csharp'").select("path", _defined(F.col("content")).alias("type_names"))


def _defined(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"\b(?:class|interface|struct|enum|record)\s+(\w+)"), 1))


def referenced_types(corpus: DataFrame) -> DataFrame:
    """Type names a C# file uses but does not define, without built-in ones: (path, type_name)."""
    c = F.col("content")
    clean = F.regexp_replace(c, r"(?m)//.*$", "")
    clean = F.regexp_replace(clean, r"(?s)/\*.*?\*/", "")
    clean = F.regexp_replace(clean, r'"(?:[^"\\]|\\.)*"', '""')
    clean = F.regexp_replace(clean, r"'(?:[^'\\]|\\.)*'", "''")
    has = lambda text, *parts: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])
    clean = F.when(has(c, "//", "/*", '"', "'"), clean).otherwise(c)
    d = corpus.filter("language = 'csharp'").select("path", clean.alias("code"), _defined(c).alias("type_names"))
    # Plain letters are looked at first, as they stand at few places; every pattern runs once a file.
    modifiers = "public|private|protected|internal|static|virtual|override|abstract|async"
    modifier = rf"(?=[piasvo])\b(?:{modifiers})"
    generic = r"[A-Z]\w+(?:<[^>]+>)?"
    code = F.col("code")
    grab = lambda p, g=1: F.regexp_extract_all("code", F.lit(p), g)
    plain = lambda a: F.transform(a, lambda s: strip(F.regexp_replace(s, "<.*>$", "")))
    method = rf"{modifier}\s+(?:(?:static|virtual|override|abstract|async)\s+)*({generic})\s+\w+\s*\(([^)]*)\)"
    d = d.select(
        "path",
        "type_names",
        grab(r"(?=[csr])\b(?:class|struct|record)\s+\w+(?:<[^>]+>)?\s*:\s*([^{]+)").alias("bases"),
        grab(rf"(?=[piasvor])\b(?:{modifiers}|readonly)\s+(?:(?:static|readonly|virtual|override|abstract|async)\s+)*({generic})\s+\w+\s*[{{;=,)]").alias("field"),
        grab(method, 0).alias("method"),
        F.concat(
            grab(r"new\s+([A-Z]\w+)\s*[(<{]"),
            grab(r"(?=[tnai])\b(?:typeof|nameof|as|is)\s*\(?\s*([A-Z]\w+)"),
            F.when(has(code, "["), grab(r"\[\s*([A-Z]\w+)\s*(?:\(|])")).otherwise(F.array().cast("array<string>")),
        ).alias("others"),
    )
    bases = F.flatten(F.transform("bases", lambda s: F.split(s, ",")))
    bases = F.transform(bases, lambda s: strip(F.regexp_replace(F.substring_index(F.regexp_replace(strip(s), r"<.*>$", ""), ".", -1), r"(?s)\s+where\s+.*", "")))
    args = F.flatten(F.transform("field", lambda s: F.split(F.regexp_extract(s, "<(.+)>", 1), ",")))
    part = lambda g: F.transform("method", lambda s: F.regexp_extract(s, method, g))
    params = F.flatten(F.transform(part(2), lambda s: F.regexp_extract_all(s, F.lit(rf"({generic})\s+\w+"), 1)))
    used = F.concat(plain(F.col("field")), plain(F.transform(args, lambda s: strip(s))), plain(part(1)), plain(params), F.col("others"))
    # Base types are kept even when they share a built-in name.
    names = F.array_union(F.filter(used, lambda x: ~x.isin(RT.BUILTIN_TYPES)), bases)
    return (
        d.select("path", "type_names", names.alias("names"))
        .select("path", F.explode(F.array_except("names", "type_names")).alias("type_name"))
        .filter(F.rlike(F.col("type_name"), F.lit(r"^[A-Z]\w+$")))
    )


def why_comments(corpus: DataFrame) -> DataFrame:
    """Rationale comments and summaries of documentation blocks: (id, file, line, text)."""
    lines = explode_lines(corpus)
    text = None
    for p in RT.WHY_PATTERNS:
        cond = F.rlike(F.col("text"), F.lit(p))
        value = F.regexp_extract("text", p, 1)
        text = F.when(cond, value) if text is None else text.when(cond, value)
    inline = lines.withColumn("why", text).filter("why IS NOT NULL").select(
        F.concat_ws(":", "path", F.col("line").cast("string"), F.lit("why")).alias("id"),
        F.col("path").alias("file"), "line", strip("why").alias("text"),
    )
    # Every block ends a piece of the text cut at "*/"; newlines before it give its line.
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    pieces = corpus.select("path", F.split("content", r"\*/", -1).alias("pieces"))
    pieces = pieces.select("path", "pieces", F.transform("pieces", newlines).alias("breaks"), F.posexplode("pieces").alias("i", "piece"))
    pieces = pieces.filter((F.col("i") < F.size("pieces") - 1) & F.contains("piece", F.lit("/**")))
    start = F.position(F.lit("/**"), F.col("piece"))
    above = F.aggregate(F.slice("breaks", F.lit(1), F.col("i")), F.lit(0), lambda acc, x: acc + x)
    at = pieces.select(
        "path",
        (above + newlines(F.substring("piece", F.lit(1), start - 1)) + 1).alias("line"),
        F.substring("piece", start + 3, F.length("piece")).alias("inner"),
    )
    cleaned = F.transform(F.split("inner", "\n", -1), lambda s: strip(F.regexp_replace(s, r"^\s*\*\s?", "")))
    summary = F.try_element_at(F.filter(cleaned, lambda s: (F.length(s) > 10) & ~F.startswith(s, F.lit("@"))), F.lit(1))
    doc = at.withColumn("summary", summary).filter("summary IS NOT NULL").select(
        F.concat_ws(":", "path", F.col("line").cast("string"), F.lit("jsdoc")).alias("id"),
        F.col("path").alias("file"), "line", F.col("summary").alias("text"),
    )
    return inline.unionByName(doc)


WORD_CALL = r"((?<![A-Za-z0-9_])[A-Za-z_$][\w$]*)\s*\("


def find_callers(corpus: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites ``symbol(`` of every symbol in a table: (symbol, path, line, column, snippet, is_test).

    Identifiers before a parenthesis are extracted once per line and joined to the symbols by
    equality, so the cost does not grow with the number of symbols. Column is the first place the
    name occurs in the line.
    """
    lines = explode_lines(corpus)
    calls = lines.select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD_CALL), 1))).alias("symbol"))
    return calls.join(symbols.select("symbol").distinct(), "symbol").select(
        "symbol", "path", "line", F.position(F.col("symbol"), F.col("text")).alias("column"),
        strip("text").alias("snippet"), is_test_path(F.col("path")).alias("is_test"),
    )


def word_lines(corpus: DataFrame, word: str) -> DataFrame:
    """Lines that contain a whole word: (path, line, column, snippet)."""
    pattern = F.lit(X.ascii_words(r"\b") + rf"\Q{word}\E" + X.ascii_words(r"\b"))
    lines = explode_lines(corpus).filter(F.rlike(F.col("text"), pattern))
    return lines.select("path", "line", F.position(F.lit(word), F.col("text")).alias("column"), strip("text").alias("snippet"))


def imported_names(corpus: DataFrame, listing: DataFrame) -> DataFrame:
    """Local names bound by imports of known files: (source, name, target)."""
    stmt = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)\bimport\s+([^'\";]+?\s+from\s*['\"]\.[^'\"]*['\"])"), 1)).alias("stmt")
    s = corpus.filter("language <> 'csharp'").select(F.col("path").alias("source"), stmt)
    clause = F.regexp_replace(F.regexp_extract("stmt", r"(?s)^(.*?)\s+from\s*['\"]", 1), r"^type\s+", "")
    braces = F.regexp_extract(clause, r"(?s)\{(.*)\}", 1)
    listed = F.transform(F.split(braces, ","), lambda x: F.regexp_extract(strip(x), r"(?:.*\s)?([\w$]+)$", 1))
    outside = strip(F.regexp_replace(clause, r"(?s)\{.*\}", ""))
    default = F.regexp_extract(outside, r"^([\w$]+)", 1)
    star = F.regexp_extract(outside, r"\*\s+as\s+([\w$]+)", 1)
    names = F.filter(F.concat(F.array(default, star), listed), lambda x: x != "")
    spec = F.regexp_extract("stmt", r"from\s*['\"]([^'\"]+)['\"]", 1)
    rows = s.select("source", spec.alias("spec"), F.explode(names).alias("name"))
    return resolve_imports(rows, listing, RELATION_SUFFIXES, keep_unresolved=False).select("source", "name", "target").distinct()


def enriched_relations(corpus: DataFrame, listing: DataFrame) -> DataFrame:
    """Calls and class relations to imported names: (source, target, type, confidence, weight, rationale)."""
    from ..session import materialize

    names = materialize(imported_names(corpus, listing), "names").df
    lines = explode_lines(corpus.filter("language <> 'csharp'"))
    word = r"([A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)?\s*\("
    text = F.regexp_replace("text", r"^\s*import\b.*$", "")
    calls = lines.select(F.col("path").alias("source"), "line", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?<![\w$.])" + word), 1)).alias("i", "name"))
    called = (
        calls.join(names, ["source", "name"])
        .groupBy("source", "target")
        .agg(F.min(F.struct("line", "i", "name")).alias("f"))
        .select(
            "source", "target", F.lit("FUNCTION_CALL").alias("rel_type"),
            F.concat(F.lit("calls "), "f.name", F.lit(" (first at line "), F.col("f.line").cast("string"), F.lit(")")).alias("rationale"),
        )
    )
    # What precedes tells a class expression, which has no name of its own, from a declaration.
    head = r"(?:[=(,:?\[]\s*|\breturn\s+|\bnew\s+)?\bclass\s+(\w+)?(?:<[^{>]*>)?\s*((?:extends|implements)\s[^{]*)\{"
    classes = corpus.filter("language <> 'csharp'").select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("content", F.lit("(?s)" + head), 0)).alias("decl"))
    cls = F.regexp_extract("decl", r"\bclass\s+(?!extends\b|implements\b)(\w+)", 1)
    label = F.when(~F.startswith("decl", F.lit("class")), "<expr>").when(cls == "", "<anonymous>").otherwise(cls)
    # Plain identifiers only: a base such as ns.Base names nothing that is imported.
    base = F.regexp_extract("decl", r"(?s)\bextends\s+([A-Za-z_$][\w$]*+)(?!\s*\.)", 1)
    impl = F.split(F.regexp_extract("decl", r"(?s)\bimplements\s+([^{]*)", 1), ",")
    heirs = classes.select(
        "source", label.alias("cls"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("CLASS_EXTENDS").alias("rel_type"), F.lit(" extends ").alias("verb"), base.alias("name"))),
                F.transform(impl, lambda x: F.struct(F.lit("IMPLEMENTS").alias("rel_type"), F.lit(" implements ").alias("verb"), F.regexp_extract(strip(x), r"^([\w$]++)(?!\s*\.)", 1).alias("name"))),
            )
        ).alias("h"),
    ).select("source", "cls", "h.*")
    inherited = heirs.filter("name <> ''").join(names, ["source", "name"]).select(
        "source", "target", "rel_type", F.concat("cls", "verb", "name").alias("rationale")
    )
    weights = F.broadcast(RT.relation_weights(corpus.sparkSession))
    return called.unionByName(inherited).join(weights, "rel_type").select(
        "source", "target", F.col("rel_type").alias("type"), F.lit("EXTRACTED").alias("confidence"), "weight", "rationale"
    )


# They look behind only where their first letters stand, not at every character.
HANDLER = r"on(?<=\bon)\w+\s*=\s*\{\s*(?:async\s+)?(?:(?:\([^)]*\)|\w+)\s*=>|function\b)"
HOOK = r"(use(?<![\w$.]use)[A-Z]\w*+)\s*+(?:<[^>()]*+>)?+\("


def react_violations(corpus: DataFrame) -> DataFrame:
    """Inline JSX handlers, too many hooks and repeated hooks, counted per file.

    One pass over the texts: the patterns run once a file, and what they find is spread to rows at the end.
    """
    c = F.col("content")
    handler = F.regexp_count(c, F.lit(HANDLER))
    # Equal names are neighbours once sorted.
    hooks = F.sort_array(F.regexp_extract_all(c, F.lit(HOOK), 1))
    d = corpus.filter("language IN ('tsx', 'jsx')").select("path", handler.alias("handlers"), hooks.alias("hooks"))
    pairs = F.zip_with("hooks", F.slice("hooks", 2, F.size("hooks")), lambda x, y: F.when(x == y, x))
    d = d.select("path", "handlers", F.size("hooks").alias("n"), F.array_distinct(F.array_compact(pairs)).alias("twice"))

    def found(cond, type_, severity, n, detail):
        return F.when(cond, F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"), n.alias("n"), detail.alias("detail")))

    rows = F.array(
        found(F.col("handlers") > 0, "inline_handler", "info", F.col("handlers"), F.lit("")),
        found(F.col("n") > 7, "hook_overload", "warning", F.col("n"), F.lit("")),
        found(F.size("twice") > 0, "duplicate_hooks", "warning", F.size("twice"), F.array_join("twice", ", ")),
    )
    return d.select("path", F.explode(F.array_compact(rows)).alias("v")).select("path", "v.*")


def fallback_analyses(files: DataFrame) -> DataFrame:
    """Analysis row of files whose content could not be read: rating 5 and one error."""
    return files.filter(F.col("content").isNull()).select(
        "path", P.language_of("path").alias("language"), F.lit(5.0).alias("rating"), F.lit("analysis_error").alias("type"),
        F.lit("error").alias("severity"), F.concat(F.lit("Analysis failed: "), F.coalesce("error", F.lit("unreadable content"))).alias("message"),
    )
