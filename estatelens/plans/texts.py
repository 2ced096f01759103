"""Catalogue: corpus-wide lexical scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as LX
from .context import Catalogue
from .fragments import with_parts

catalogue = Catalogue()
add = catalogue.add

# Example rules for prose: repeated words are not code, but exercise the same scan.
TEXT_RULES = [
    {"type": "the_word", "severity": "warning", "pattern": r"\bthe\b", "scope": "line"},
    {"type": "digits", "severity": "info", "pattern": r"[0-9]{3,}", "scope": "line"},
    {"type": "mail", "severity": "error", "pattern": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "scope": "file"},
    {"type": "link", "severity": "info", "pattern": r"https?://", "scope": "file"},
]


@add("text_lines", with_parts("SELECT path, CAST(line AS INT) AS line, text FROM lines", "lines"))
def _(t):
    return LX.explode_lines(t.corpus).drop("language")


@add("content_hashes", with_parts("SELECT path, sha1(content) AS file_hash FROM corpus", "corpus"))
def _(t):
    return t.corpus.select("path", F.sha1("content").alias("file_hash"))


@add("file_line_counts", with_parts("SELECT path, CAST(len(string_split(content, chr(10))) AS INT) AS loc FROM corpus", "corpus"))
def _(t):
    return LX.lexical_metrics(t.corpus).select("path", F.col("loc").cast("int").alias("loc"))


_COUNT = lambda p, c: f"len(regexp_extract_all({c}, '{p}'))"


@add(
    "rule_scan",
    with_parts(
        " UNION ALL ".join(
            [
                f"SELECT path, CAST(line AS INT) AS line, '{r['type']}' AS type, '{r['severity']}' AS severity, CAST({_COUNT(r['pattern'], 'text')} AS INT) AS matches FROM lines WHERE regexp_matches(text, '{r['pattern']}')"
                if r["scope"] == "line"
                else f"SELECT path, -1 AS line, '{r['type']}' AS type, '{r['severity']}' AS severity, CAST({_COUNT(r['pattern'], 'content')} AS INT) AS matches FROM corpus WHERE regexp_matches(content, '{r['pattern']}')"
                for r in TEXT_RULES
            ]
        ),
        "lines",
    ),
)
def _(t):
    return LX.scan_rules(t.corpus, TEXT_RULES).fillna(-1, ["line"])


@add(
    "marker_scan",
    with_parts(
        """, m AS (SELECT path, CAST(line AS INT) AS line, CASE WHEN regexp_matches(text, '(?i)(//|/\\*)\\s*(TODO|FIXME|PLACEHOLDER|STUB)\\b') THEN 'todo_placeholder'
        WHEN regexp_matches(text, '(?i)(//|/\\*)\\s*(HACK|WORKAROUND|KLUDGE|XXX)\\b') THEN 'tech_debt_marker'
        WHEN regexp_matches(text, '(?i)throw\\s+new\\s+(Error|TypeError|RangeError)\\s*\\(\\s*[''"`](not\\s+implemented|todo|placeholder|stub)') THEN 'unimplemented_stub' END AS type FROM code_lines)
        SELECT * FROM m WHERE type IS NOT NULL""",
        "code_lines",
    ),
)
def _(t):
    # Prose has no comments: every fifth line style is turned into one of the marker forms.
    lead = (
        F.when(F.col("language") == "en", "// TODO ").when(F.col("language") == "fr", "/* hack ").when(F.col("language") == "de", "throw new Error('todo ").otherwise("")
    )
    code = t.corpus.withColumn("content", F.concat(lead, F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), lead))))
    return LX.marker_violations(code.withColumn("language", F.lit("typescript"))).select("path", "line", "type")


@add(
    "find_word_lines",
    with_parts("SELECT path, CAST(line AS INT) AS line, CAST(instr(text, 'the') AS INT) AS \"column\", trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS snippet FROM lines WHERE regexp_matches(text, '\\bthe\\b')", "lines"),
)
def _(t):
    return LX.word_lines(t.corpus, "the")


_CALLS = """, s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS symbol FROM benchmark),
  c AS (SELECT path, line, text, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1))) AS symbol FROM calls)
  SELECT c.symbol, path, CAST(line AS INT) AS line, CAST(instr(text, c.symbol) AS INT) AS "column", contains(path, '.test.') OR contains(path, '.spec.') AS is_test FROM c JOIN s USING (symbol)"""


@add("find_callers", with_parts(_CALLS, "calls"))
def _(t):
    symbols = t.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("symbol"))
    code = t.corpus.withColumn("content", F.replace("content", F.lit(" "), F.lit("( ")))
    return LX.find_callers(code, symbols).drop("snippet")


@add(
    "page_links",
    """SELECT url AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages""",
)
def _(t):
    return LX.link_targets(t.raw("pages").select(F.col("url").alias("source"), F.col("html").alias("content")))


@add(
    "external_dependencies",
    """WITH l AS (SELECT url AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
    SELECT target, count(*) AS uses, count(DISTINCT source) AS files FROM l WHERE target NOT IN (SELECT url FROM pages) GROUP BY target""",
)
def _(t):
    links = LX.link_targets(t.raw("pages").select(F.col("url").alias("source"), F.col("html").alias("content")))
    known = t.raw("pages").select(F.col("url").alias("target")).distinct()
    pairs = links.join(known, "target", "left_anti").groupBy("target", "source").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("target").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("files"))


@add(
    "why_comments",
    with_parts(
        """SELECT path || ':' || line || ':why' AS id, path AS file, CAST(line AS INT) AS line, trim(regexp_extract(text, '(?i)//\\s*(?:why|because):\\s*(.+)', 1), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS text
        FROM why_lines WHERE regexp_matches(text, '(?i)//\\s*(why|because):\\s*(.+)')
        UNION ALL SELECT path || ':' || n || ':jsdoc', path, CAST(n AS INT), 'Summary of ' || path FROM (SELECT path, len(string_split(content, chr(10))) + 1 AS n FROM corpus WHERE content IS NOT NULL)""",
        "why_lines",
        "corpus",
    ),
)
def _(t):
    lead = F.when(F.col("language") == "en", "// why: ").when(F.col("language") == "fr", "//because: ").otherwise("")
    block = F.concat(F.lit("\n/**\n * Summary of "), "path", F.lit("\n * @returns nothing of interest\n */"))
    code = t.corpus.withColumn("content", F.concat(lead, F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), lead)), block))
    return LX.why_comments(code)


def _line_texts(t, content, language: str):
    """One short source text per order line, built from its columns, which are made distinct before they become text."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = t.raw("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int")).select(*keys, "l_returnflag").distinct()
    path = F.concat(F.lit("/w/"), F.concat_ws("_", *[F.col(c).cast("string") for c in keys]))
    return lines.select(path.alias("path"), F.lit(language).alias("language"), content.alias("content"))


_KEY = "'/w/' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(l_quantity AS INT)"
_LINES = f"WITH l AS (SELECT DISTINCT {_KEY} AS path, CAST(l_quantity AS INT) AS q, l_linenumber AS n, l_returnflag AS f, l_partkey AS p, l_suppkey AS s FROM lineitem)"


@add("file_metrics", f"{_LINES} SELECT path, CAST(n + q + 2 AS INT) AS loc, CAST(n AS INT) AS methods, 1 AS classes, CAST(q + 1 AS INT) AS complexity, 1 AS imports FROM l")
def _(t):
    times = lambda text, c: F.repeat(F.lit(text), F.col(c).cast("int"))
    content = F.concat(F.lit("import a from 'a';\n"), times("function f() { }\n", "l_linenumber"), times("if (a) b;\n", "l_quantity"), F.lit("class A { }"))
    return LX.lexical_metrics(_line_texts(t, content, "typescript")).drop("language")


@add(
    "type_rule_scan",
    f"""{_LINES} SELECT path, 1 AS line, type, 'warning' AS severity, 2 AS matches FROM l, (VALUES ('any_type'), ('any_usage')) v(type) WHERE f = 'R'
    UNION ALL SELECT path, 2, type, 'info', CAST(n AS INT) FROM l, (VALUES ('console_log'), ('snippet:console_log')) v(type)
    UNION ALL SELECT path, 3, 'snippet:console_log', 'info', 1 FROM l""",
)
def _(t):
    first = F.when(F.col("l_returnflag") == "R", "let a: any = b as any;\n").otherwise("let a = company;\n")
    content = F.concat(first, F.repeat(F.lit("console.log(a); "), F.col("l_linenumber").cast("int")), F.lit("\nconsole.warn(a)"))
    code = _line_texts(t, content, "typescript")
    snippet = [r | {"type": r["type"] if r["type"] == "any_usage" else f"snippet:{r['type']}"} for r in LX.SNIPPET_TYPE_RULES]
    return LX.scan_rules(code, LX.TYPE_RULES + snippet)


@add(
    "react_scan",
    f"""{_LINES} SELECT path, 'inline_handler' AS type, 'info' AS severity, 1 AS n, '' AS detail FROM l WHERE f = 'R'
    UNION ALL SELECT path, 'hook_overload', 'warning', q + 1, '' FROM l WHERE q + 1 > 7
    UNION ALL SELECT path, 'duplicate_hooks', 'warning', 1, 'useQuantity' FROM l WHERE q > 1""",
)
def _(t):
    q = F.col("l_quantity").cast("int")
    handler = F.when(F.col("l_returnflag") == "R", "onClick={() => go()}").otherwise("onClick={go}")
    content = F.concat(F.lit("const C = () => { useOrder(); "), F.repeat(F.lit("useQuantity(); "), q), F.lit("return <a "), handler, F.lit(" /> }"))
    return LX.react_violations(_line_texts(t, content, "tsx"))


@add(
    "csharp_scan",
    f"""{_LINES} SELECT path, 'god_class' AS type, 'warning' AS severity, 1 AS occurrences, 'Class has ' || (q + 1) || ' methods — consider splitting responsibilities (Single Responsibility Principle)' AS message FROM l WHERE q + 1 > 20
    UNION ALL SELECT path, 'tight_coupling', 'warning', 1, 'Constructor has ' || n || ' parameters — consider using a configuration object or DI container' FROM l WHERE n > 5
    UNION ALL SELECT path, 'magic_number', 'info', 1, 'Magic number ' || s || ' — extract to a named constant' FROM l WHERE s >= 10
    UNION ALL SELECT path, 'empty_catch', 'error', 1, 'Empty catch block silently swallows exceptions' FROM l WHERE f = 'A'""",
)
def _(t):
    q = F.col("l_quantity").cast("int")
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda i: F.concat(F.lit("int a"), i.cast("string"))), ", ")
    silent = F.when(F.col("l_returnflag") == "A", "try { F(); } catch (Exception e) { }").otherwise("F();")
    content = F.concat(
        F.lit("class Line {\n  public Line("), params, F.lit(") { x = "), F.col("l_suppkey").cast("string"), F.lit("; }\n"),
        F.repeat(F.lit("  private void M() { }\n"), q), F.lit("  public int Run() { "), silent, F.lit(" }\n}"),
    )
    return LX.csharp_violations(_line_texts(t, content, "csharp"))


@add(
    "type_references",
    f"""{_LINES} SELECT path, 'Part' || p AS type_name FROM l UNION ALL SELECT path, 'Supplier' || s FROM l""",
)
def _(t):
    part, supp = F.concat(F.lit("Part"), F.col("l_partkey").cast("string")), F.concat(F.lit("Supplier"), F.col("l_suppkey").cast("string"))
    content = F.concat(F.lit("public class Line : "), part, F.lit("\n{\n  private List<"), supp, F.lit("> all;\n  public Line Make() { return new "), supp, F.lit("(); }\n}"))
    return LX.referenced_types(_line_texts(t, content, "csharp"))


def _edge_texts(t):
    """One short module per dependency edge that imports and uses its target."""
    name = lambda c: F.regexp_extract(c, r"(part_\d+)\.", 1)
    e = t.local.select(name(F.col("source")).alias("a"), name(F.col("target")).alias("b"), "type")
    use = F.when(F.col("type") == "import", F.concat("b", F.lit(".run()"))).otherwise(F.concat(F.lit("class Child extends "), "b", F.lit(" {}")))
    content = F.concat(F.lit("import { "), "b", F.lit(" } from '../b/"), "b", F.lit("';\n"), use, F.lit("\n"))
    return e.select(F.concat(F.lit("/w/a/"), "a", F.lit("_to_"), "b", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), content.alias("content"), "b")


_EDGE = """, e AS (SELECT regexp_extract(source, '(part_[0-9]+)[.]', 1) AS a, regexp_extract(target, '(part_[0-9]+)[.]', 1) AS b, type FROM local)"""


@add("extract_imports", with_parts(_EDGE + " SELECT '/w/a/' || a || '_to_' || b || '.ts' AS source, 0 AS i, '../b/' || b AS spec, 'import' AS type FROM e", "local"))
def _(t):
    return LX.extract_imports(_edge_texts(t))


@add(
    "enriched_relations",
    with_parts(
        _EDGE
        + """ SELECT '/w/a/' || a || '_to_' || b || '.ts' AS source, '/w/b/' || b || '.ts' AS target, CASE type WHEN 'import' THEN 'FUNCTION_CALL' ELSE 'CLASS_EXTENDS' END AS type, 'EXTRACTED' AS confidence,
        CASE type WHEN 'import' THEN 2.0 ELSE 3.0 END::DOUBLE AS weight, CASE type WHEN 'import' THEN 'calls ' || b || ' (first at line 2)' ELSE 'Child extends ' || b END AS rationale FROM e""",
        "local",
    ),
)
def _(t):
    c = _edge_texts(t)
    listing = t.files.select(F.concat(F.lit("/w/b/part_"), F.col("part").cast("string"), F.lit(".ts")).alias("path"))
    return LX.enriched_relations(c, listing)


@add(
    "analysis_fallbacks",
    with_parts("SELECT path, 5.0::DOUBLE AS rating, 'analysis_error' AS type FROM corpus WHERE language NOT IN ('en', 'fr')", "corpus"),
)
def _(t):
    broken = t.corpus.select("path", F.when(F.col("language").isin("en", "fr"), F.col("content")).alias("content"), F.lit("bad encoding").alias("error"))
    return LX.fallback_analyses(broken).select("path", "rating", "type")
