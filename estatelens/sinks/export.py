"""Graph exports as ordered text rows: JSON lines, GraphML, Cypher and a violation summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rating as R
from ..session import global_index


def escape_xml(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def cypher_string(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fixed(spark, section: int, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, "", i, t) for i, t in enumerate(texts)], "section int, key string, ord int, line string")


def _lines(df: DataFrame, section: int, key: Column, items: list[Column]) -> DataFrame:
    exploded = df.select(key.alias("key"), F.posexplode(F.array_compact(F.array(*items))).alias("ord", "line"))
    return exploded.select(F.lit(section).alias("section"), "key", "ord", "line")


# The frame of a GraphML document.
GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/graphml">',
    '  <key id="rating" for="node" attr.name="rating" attr.type="double"/>',
    '  <key id="linesOfCode" for="node" attr.name="linesOfCode" attr.type="int"/>',
    '  <key id="label" for="node" attr.name="label" attr.type="string"/>',
    '  <key id="edgeType" for="edge" attr.name="type" attr.type="string"/>',
    '  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>',
    '  <graph id="G" edgedefault="directed">',
]
GRAPHML_TAIL = ["  </graph>", "</graphml>"]


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as rows (section, key, ord, line); sort by the first three for the document."""
    spark = nodes.sparkSession
    n = _lines(
        nodes,
        1,
        F.col("id"),
        [
            _say('    <node id="', escape_xml(F.col("id")), '">'),
            _say('      <data key="label">', escape_xml(F.col("label")), "</data>"),
            _say('      <data key="rating">', R.js_num(F.col("rating")), "</data>"),
            F.when(F.col("loc").isNotNull(), _say('      <data key="linesOfCode">', F.col("loc").cast("string"), "</data>")),
            F.lit("    </node>"),
        ],
    )
    numbered = global_index(edges.select("source", "target", "type", "strength"), "source", "target")
    e = _lines(
        numbered,
        2,
        F.concat("source", F.lit("\u0001"), F.col("target")),
        [
            _say(
                '    <edge id="e', F.col("idx").cast("string"), '" source="', escape_xml(F.col("source")),
                '" target="', escape_xml(F.col("target")), '">',
            ),
            _say('      <data key="edgeType">', escape_xml(F.coalesce("type", F.lit("IMPORT"))), "</data>"),
            _say('      <data key="weight">', R.js_num(F.coalesce("strength", F.lit(1.0))), "</data>"),
            F.lit("    </edge>"),
        ],
    )
    return _fixed(spark, 0, GRAPHML_HEAD).unionByName(n).unionByName(e).unionByName(_fixed(spark, 3, GRAPHML_TAIL))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cypher import script as rows (section, key, ord, line)."""
    spark = nodes.sparkSession
    # The head and the statement texts below.
    head = [
        "// Cypher import script",
        "// Run: cypher-shell < graph.cypher",
        "",
        "// Clear existing (optional):",
        "// MATCH (n:File) DETACH DELETE n;",
        "",
        "// Nodes",
    ]
    props = F.concat_ws(
        ", ",
        _say("id: ", cypher_string(F.col("id"))),
        _say("label: ", cypher_string(F.col("label"))),
        _say("rating: ", R.js_num(F.col("rating"))),
        _say("linesOfCode: ", F.col("loc").cast("string")),
        _say("complexity: ", F.col("complexity").cast("string")),
    )
    n = _lines(nodes, 1, F.col("id"), [_say("CREATE (:File {", props, "});")])
    rel = F.upper(F.regexp_replace(F.coalesce("type", F.lit("IMPORT")), r"\W", "_"))
    e = _lines(
        edges,
        3,
        F.concat("source", F.lit("\u0001"), F.col("target")),
        [
            _say(
                "MATCH (a:File {id: ", cypher_string(F.col("source")), "}), (b:File {id: ", cypher_string(F.col("target")),
                "}) CREATE (a)-[:", rel, " {weight: ", R.js_num(F.coalesce("strength", F.lit(1.0))), "}]->(b);",
            )
        ],
    )
    return _fixed(spark, 0, head).unionByName(n).unionByName(_fixed(spark, 2, ["", "// Relationships"])).unionByName(e)


def write_lines(lines: DataFrame, target: str) -> None:
    """Write ordered lines as text part files whose concatenation is the document."""
    order = ["section", "key", "ord"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(target)


def json_sections(nodes: DataFrame, edges: DataFrame, violations: DataFrame | None = None) -> dict[str, DataFrame]:
    """JSON-lines sections of a graph document: nodes and edges."""
    n = nodes.select(
        F.to_json(
            F.struct(
                "id", F.lit("file").alias("type"), "label", "rating",
                F.struct(F.col("loc").alias("linesOfCode"), F.col("complexity").alias("cyclomaticComplexity"), F.col("imports").alias("importCount")).alias("metrics"),
            )
        ).alias("json")
    )
    e = edges.select(
        F.to_json(
            F.struct(
                "source", "target", F.upper(F.coalesce("type", F.lit("IMPORT"))).alias("type"),
                F.lit("EXTRACTED").alias("confidence"), F.coalesce("strength", F.lit(1.0)).alias("weight"),
            )
        ).alias("json")
    )
    out = {"nodes": n, "edges": e}
    if violations is not None:
        out["violations"] = violations.select(F.to_json(F.struct(F.col("path").alias("id"), "type", "severity")).alias("json"))
    return out


def write_json(sections: dict[str, DataFrame], target: str) -> None:
    for name, rows in sections.items():
        rows.write.mode("overwrite").text(f"{target}/{name}")


def export_sections(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Derived sections of the graph document as rows: hubs, surprising edges, questions, cycles."""
    from ..operators.centrality import god_nodes
    from ..operators.coupling import suggested_questions, surprising

    god = god_nodes(edges, nodes, 10).select(F.lit("god_nodes").alias("section"), F.col("path").alias("item"))
    odd = surprising(edges, nodes, 10).select(F.lit("surprising").alias("section"), F.concat("source", F.lit(" -> "), "target").alias("item"))
    ask = suggested_questions(edges, nodes, 5).select(F.lit("questions").alias("section"), F.col("question").alias("item"))
    cyc = components.select(F.lit("cycle_members").alias("section"), F.col("path").alias("item"))
    return god.unionByName(odd).unionByName(ask).unionByName(cyc)


def violation_lines(violations: DataFrame) -> DataFrame:
    """Plain-text violation summary, one block per file, as rows (key, sub, ord, line)."""
    head = violations.select("path").distinct().select(
        F.col("path").alias("key"), F.lit("").alias("sub"), F.lit(0).alias("ord"), F.concat(F.lit("### "), P.basename("path")).alias("line")
    )
    foot = violations.select("path").distinct().select(
        F.col("path").alias("key"), F.lit("￿").alias("sub"), F.lit(0).alias("ord"), F.lit("").alias("line")
    )
    loc = F.when(F.col("line") > 0, _say(" (line ", F.col("line").cast("string"), ")")).otherwise("")
    body = violations.select(
        F.col("path").alias("key"),
        F.concat_ws(":", "severity", "type", F.format_string("%09d", F.coalesce("line", F.lit(0)))).alias("sub"),
        F.posexplode(
            F.array_compact(
                F.array(
                    _say("  [", F.upper("severity"), "] ", F.col("message"), loc),
                    F.when(F.col("fix.description").isNotNull(), _say("    Fix: ", F.col("fix.description"))),
                )
            )
        ).alias("ord", "line"),
    )
    return head.unionByName(body).unionByName(foot)
