"""Sources, sinks, ratings, filters, joins and lexical scans on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from estatelens import schemas as S
from estatelens.functions import paths as P
from estatelens.functions import rating as R
from estatelens.functions import text as X
from estatelens.operators import coverage as CV
from estatelens.operators import filters as FL
from estatelens.operators import graph_build as GB
from estatelens.operators import joins as JN
from estatelens.operators import lexical as LX
from estatelens.operators import merge as MG
from estatelens.operators import patterns as PT
from estatelens.operators import windows as WN
from estatelens.rules import tables as RT
from estatelens.sinks import export as EX
from estatelens.sinks import store as ST
from estatelens.sources import files as SF
from estatelens.sources import tables as TB
from estatelens.sources import adapters as AD


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def analysis(path, deps=(), types=(), violations=(), rating=8.0, seq=0, **metrics):
    m = dict(linesOfCode=100, cyclomaticComplexity=5, numberOfMethods=10, numberOfClasses=2, importCount=5)
    m.update(metrics)
    return {
        "repo": "/r", "path": path, "language": "csharp", "rating": rating, "seq": seq, "metrics": m, "definedTypes": list(types),
        "dependencies": [{"source": path, "target": t, "type": k, "weight": w} for t, k, w in deps],
        "violations": [{"type": t, "severity": s} for t, s in violations],
    }


def table(spark, *rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", S.ANALYSIS).alias("a")).select("a.*")


@pytest.mark.parametrize(
    "violations,metrics,want",
    [
        ([], {}, 10.0),
        (["error"], {}, 8.5),
        (["warning", "info", "info"], {}, 9.3),
        (["info"] * 3, {}, 9.7),
        (["error"] * 9, {}, 0.0),
        ([], {"coveragePercent": 29.9}, 7.5),
        ([], {"coveragePercent": 30.0}, 8.0),
        ([], {"coveragePercent": 79.9}, 9.0),
        ([], {"coveragePercent": 80.0}, 10.0),
        ([], {"numberOfMethods": 21}, 9.5),
        ([], {"numberOfMethods": 41}, 8.5),
        ([], {"linesOfCode": 405}, 8.5),
        ([], {"cyclomaticComplexity": 11}, 9.0),
        ([], {"cyclomaticComplexity": 21}, 8.0),
        ([], {"importCount": 31}, 8.0),
        ([], {"linesOfCode": 501, "numberOfMethods": 20}, 8.5),
    ],
)
def test_rating(spark, violations, metrics, want):
    t = table(spark, analysis("/a", violations=[("x", s) for s in violations], **metrics))
    row = t.select(R.rating(F.col("violations"), F.col("metrics")).alias("r"), R.breakdown(F.col("violations"), F.col("metrics")).alias("b")).first()
    assert row.r == want
    assert max(0.0, round(10 - sum(i.deduction for i in row.b), 1)) == want


def test_breakdown_text(spark):
    t = table(spark, analysis("/a", violations=[("x", "error")] * 2, coveragePercent=12.34, numberOfMethods=2, linesOfCode=101))
    items = t.select(F.inline(R.breakdown(F.col("violations"), F.col("metrics")))).collect()
    assert [(i.category, i.deduction, i.detail) for i in items] == [
        ("Errors (2)", 3.0, "2 × −1.5 pts"),
        ("Critical Coverage Gap", 2.5, "12.3% < 30% — changes are blind"),
        ("Long Methods (avg)", 1.0, "avg 51 LOC/method > 40"),
    ]


def test_build_graph(spark):
    t = table(
        spark,
        analysis("/a.cs", [("/b.cs", "import", 1.0), ("/b.cs", "usage", 2.0), ("__type__:Foo", "usage", 1.0), ("__type__:Own", "usage", 1.0), ("lodash", "import", 1.0)], ["Own"], seq=0),
        analysis("/b.cs", [("/b.cs", "import", 1.0)], ["Foo"], seq=1),
        analysis("/c.cs", [("__type__:Nope", "usage", 1.0)], ["Foo"], seq=2),
    )
    nodes, edges = GB.build_graph(t)
    assert {(r.id, r.label, r.size) for r in nodes.collect()} == {("/a.cs", "a.cs", 1.0), ("/b.cs", "b.cs", 1.0), ("/c.cs", "c.cs", 1.0)}
    assert {(r.source, r.target, r.type, r.strength) for r in edges.collect()} == {("/a.cs", "/b.cs", "import", 1.0), ("/b.cs", "/b.cs", "import", 1.0)}


def test_modules_and_distance(spark):
    m = lambda p, **k: one(spark, P.module_of(F.col("p"), F.lit("/repo"), **k), p=p)
    assert [m("/repo/src/auth/x.ts"), m("/repo/x.ts"), m("/repo/src/x.ts"), m("/repo/packages/core/x.ts"), m("/repo/tools/a/x.ts")] == ["auth", "(root)", "src", "core", "tools"]
    assert m("/repo/packages/core/x.ts", prefixes=P.MODULE_PREFIXES_NARROW) == "packages"
    assert one(spark, P.relative_path(F.col("r"), F.col("p")), r="/a/b", p="/a/c/d.ts") == "../c/d.ts"
    d = lambda a, b: one(spark, P.directory_distance(F.col("a"), F.col("b")), a=a, b=b)
    assert [d("/r/a/x", "/r/a/y"), d("/r/a/x", "/r/b/y"), d("/r/x", "/r/b/c/y")] == [0, 2, 2]
    assert one(spark, P.fold_dots(F.col("p")), p="/a/b/../c/./d") == "/a/c/d"
    assert [one(spark, P.extension(F.col("p")), p=p) for p in ("/a/b.test.ts", "/a/.gitignore", "/a/b")] == [".ts", "", ""]


@pytest.mark.parametrize(
    "text,path,want",
    [
        ("*.log", "/r/a/b.log", True),
        ("# note\n\n", "/r/a.ts", False),
        ("*.ts\n!keep.ts", "/r/src/keep.ts", False),
        ("!keep.ts\n*.ts", "/r/src/keep.ts", True),
        ("dist/", "/r/dist/x.js", True),
        ("dist/", "/r/src/dist/x.js", False),
        ("src/**/gen.ts", "/r/src/a/b/gen.ts", True),
        ("f?o.ts", "/r/foo.ts", True),
        ("f?o.ts", "/r/fo.ts", False),
        ("*.TS", "/r/a.ts", False),
    ],
)
def test_ignore_rules(spark, text, path, want):
    rules = SF.parse_ignore(spark.createDataFrame([("/r", text)], "repo string, content string"))
    files = spark.createDataFrame([("/r", path)], "repo string, path string")
    assert FL.ignored(files, rules).first().ignored is want


def test_exclude_rules(spark):
    rules = spark.createDataFrame([("global", "**/gen/**"), ("csharp", "*.Designer.cs"), ("typescript", "*.d.ts")], "lang_group string, pattern string")
    files = spark.createDataFrame([("/r/gen/a.ts",), ("/r/A.designer.cs",), ("/r/x.d.ts",), ("/r/x.ts",), ("/r/d.cs",)], "path string")
    want = {"/r/gen/a.ts", "/r/A.designer.cs", "/r/x.d.ts"}
    assert {r.path for r in FL.excluded(files, rules).filter("excluded").collect()} == want


LCOV = """TN:
SF:src/a.ts
DA:1,5
DA:2,0
DA:3,0
DA:5,0
LF:4
LH:1
end_of_record
SF:/abs/b.ts
DA:1,1
DA:2,0
end_of_record
SF:empty.ts
end_of_record
"""


def test_lcov(spark, tmp_path):
    (tmp_path / "lcov.info").write_text(LCOV)
    parts = SF.parse_lcov(SF.read_lcov(spark, str(tmp_path / "lcov.info"), "/proj"))
    roll = CV.coverage_rollup(parts["lines"], parts["declared"])
    assert {r.path: (r.found, r.hit, r.percent) for r in roll.collect()} == {
        "/proj/src/a.ts": (4, 1, 25.0), "/abs/b.ts": (2, 1, 50.0), "/proj/empty.ts": (0, 0, 100.0)
    }
    files = spark.createDataFrame([("/proj/src/a.ts",), ("/other/abs/b.ts",), ("/proj/none.ts",)], "path string")
    got = {(r.path, r.type): r.message for r in CV.coverage_violations(files, parts["lines"], roll).collect()}
    assert got[("/proj/src/a.ts", "low_test_coverage")] == "Test coverage is 25.0% — aim for at least 80%"
    assert got[("/proj/src/a.ts", "uncovered_lines")] == "3 lines not covered by tests: 2-3, 5"
    assert ("/proj/none.ts", "no_test_coverage") in got
    assert ("/other/abs/b.ts", "no_test_coverage") in got  # last three segments differ


def test_coverage_match_by_tail(spark):
    files = spark.createDataFrame([("/p/src/x/a.ts",), ("/p/q.ts",)], "path string")
    cov = spark.createDataFrame([("/ci/src/x/a.ts", 2), ("x/a.ts", 1), ("q.ts", 5)], "cov_path string, seq int")
    assert {r.path: r.cov_path for r in JN.match_coverage(files, cov).collect()} == {"/p/src/x/a.ts": "x/a.ts", "/p/q.ts": "q.ts"}


def test_line_ranges_are_cut_after_ten(spark):
    lines = spark.createDataFrame([("a", i) for i in range(1, 26, 2)], "path string, line int")
    r = WN.uncovered_ranges(lines).first()
    assert r.ranges == "1, 3, 5, 7, 9, 11, 13, 15, 17, 19 (+3 more)" and r.n_lines == 13


def test_pick_reports(spark):
    found = spark.createDataFrame([("/p", "/p/lcov.info"), ("/p", "/p/coverage/lcov.info"), ("/q", "/q/x/lcov.info")], "project string, path string")
    assert [(r.project, r.path) for r in SF.pick_reports(found).collect()] == [("/p", "/p/coverage/lcov.info")]


def test_scan_tree(spark, tmp_path):
    for p in ("src/a.ts", "node_modules/x.ts", ".hidden/y.ts", "lib/b.cs", "lib/c.py", "target/d.ts", "src/__tests__/t.ts", "src/_app.tsx", "a/b/c/__x__/.e.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n")
    root = str(tmp_path)
    got = {r.path[len(root) + 1 :]: (r.language, r.file_hash) for r in SF.scan_tree(spark, root).collect()}
    more = {"src/__tests__/t.ts", "src/_app.tsx", "a/b/c/__x__/.e.ts"}
    assert set(got) == {"src/a.ts", "lib/b.cs", "target/d.ts"} | more and got["lib/b.cs"][0] == "csharp"
    assert got["src/a.ts"][1] == "6fcf9dfbd479ed82697fee719b9f8c610a11ff2a"
    health = {r.path[len(root) + 1 :] for r in SF.health_files(spark, root).collect()}
    assert health == {"src/a.ts", "lib/b.cs", ".hidden/y.ts"} | more


def test_scan_tree_opens_no_skipped_folder(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"node_modules/m{i}").mkdir(parents=True)
        (tmp_path / f"node_modules/m{i}/x.ts").write_text("x")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a b.ts").write_text("é")
    (tmp_path / "empty").mkdir()
    (tmp_path / "src/loop").symlink_to(tmp_path)
    found, n = SF._source_files(spark, str(tmp_path), SF.RT.SCAN_SKIP_DIRS, True)
    tables = {p.rsplit("/", 1)[0] for p in found.inputFiles()}
    rows = spark.read.parquet(*tables).select("path").collect()
    assert n == 1 and {r.path[len(str(tmp_path)) :] for r in rows} == {"/src", "/src/a b.ts", "/empty"}
    row = SF.scan_tree(spark, str(tmp_path) + "/").collect()
    assert [(r.content, r.size, r.root) for r in row] == [("é", 2, str(tmp_path))]
    assert [r.path for r in SF.scan_tree(spark, f"file://{tmp_path}", listing_only=True).collect()] == [f"{tmp_path}/src/a b.ts"]
    assert SF.scan_tree(spark, str(tmp_path / "empty")).count() == 0


def test_read_ignore(spark, tmp_path):
    assert SF.read_ignore(spark, str(tmp_path)).count() == 0
    (tmp_path / SF.IGNORE_FILE).write_text("# note\n*.log\n!keep.log\nbuild/\n\n")
    got = [(r.ord, r.pattern, r.negate) for r in SF.read_ignore(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(1, "*.log", False), (2, "keep.log", True), (3, "build", False)]


def test_load_graph(spark, tmp_path):
    doc = {"repo": "/r", "nodes": [{"id": "/r/a.ts", "rating": 7.5}, {"id": "/r/b.ts"}], "edges": [{"source": "/r/a.ts", "target": "/r/b.ts"}], "repos": [{"path": "/r"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "h.json").write_text(json.dumps({"repo": "/q", "nodes": [], "edges": [], "repos": []}))
    got = TB.load_graph(spark, str(tmp_path))
    assert {(r.repo, r.id, r.rating) for r in got["nodes"].collect()} == {("/r", "/r/a.ts", 7.5), ("/r", "/r/b.ts", None)}
    assert [(r.repo, r.source, r.target) for r in got["edges"].collect()] == [("/r", "/r/a.ts", "/r/b.ts")]
    assert got["repos"].count() == 1


def test_import_resolution(spark):
    listing = spark.createDataFrame([("/r/src/b.tsx",), ("/r/src/c/index.ts",), ("/r/src/b.ts",)], "path string")
    imports = spark.createDataFrame([("/r/src/a.ts", s) for s in ("./b", "./c", "../x", "react")], "source string, spec string")
    got = {r.spec: (r.target, r.is_known) for r in JN.resolve_imports(imports, listing).collect()}
    assert got == {"./b": ("/r/src/b.ts", True), "./c": ("/r/src/c/index.ts", True), "../x": ("/r/x", False), "react": ("react", False)}


def test_missing_tests(spark):
    listing = spark.createDataFrame(
        [("/r/a.ts", "x"), ("/r/a.test.ts", "it('x', () => {})"), ("/r/b.ts", "x"), ("/r/__tests__/b.ts", "// later"), ("/r/c.ts", "x"), ("/r/D.cs", "[ExcludeFromCodeCoverage]"), ("/r/jest.config.ts", "x")],
        "path string, content string",
    )
    files = listing.withColumn("root", F.lit("/r"))
    got = {(r.path, r.type) for r in CV.missing_test_violations(files, listing).collect()}
    assert got == {("/r/b.ts", "hollow_test_file"), ("/r/c.ts", "no_test_file")}


@pytest.mark.parametrize("large", [3, 1000])
def test_next_in_group_slices_large_groups_only(spark, monkeypatch, large):
    rows = [(g, h, (7 * i) % 31, i) for g, n in (("a", 2), ("b", 31), ("c", 1)) for h in (0, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h int, at int, v int")
    tags, write = [], WN.materialize
    monkeypatch.setattr(WN, "materialize", lambda df, tag="stage", **more: tags.append(tag) or write(df, tag, **more))
    monkeypatch.setattr(WN, "LARGE_GROUP", large)
    want = {}
    for g, h in {r[:2] for r in rows}:
        own = sorted((r[2], r[3]) for r in rows if r[:2] == (g, h))
        want |= {(g, h, v): n for (_, v), (_, n) in zip(own, [*own[1:], (None, None)])}
    got = WN.next_in_group(df, ["g", "h"], ["at", "v"], "v", "next").collect()
    assert len(got) == len(rows) and {(r.g, r.h, r.v): r.next for r in got} == want
    assert ("slices" in tags) == (large == 3)  # every call wrote all its rows as slices before


def test_files_are_not_sent_through_the_driver(spark, sf):
    e = AD.snapshot_edges(spark, sf)
    for df in (e, AD.snapshot_nodes(spark, sf, "F", e), AD.raw_dependencies(spark, sf)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_name_parts(spark):
    """All names in order of preference, tried one by one, give the same pairs; no side of the joins is sent to the driver."""
    exts = [".ts", ".tsx", ".js", ".jsx"]

    def names(path):
        folder, _, name = path.rpartition("/")
        stem, dot, end = name.rpartition(".")
        stem, own = (stem, dot + end) if stem else (name, "")
        side = folder[2:]
        out = [f"{folder}/{stem}{s}{e}" for s in (".test", ".spec") for e in (own, *exts)]
        out += [f"{folder}/{stem}{s}.cs" for s in ("Test", "Tests", ".Test", ".Tests") if own == ".cs"]
        places = [f"{folder}/__tests__", *[f"/r/{d}{side}" for d in ("tests", "test", "__tests__")]]
        return out + [f"{p}/{stem}{s}{e}" for p in places for s in ("", ".test", ".spec") for e in (own, *exts)]

    files = [f"/r{d}/{n}" for d in ("", "/s", "/s/t") for n in ("a.ts", "a.b.js", "A.cs", "c", ".rc", "x.test.ts", "d.")]
    tried = sorted({n for f in files for n in names(f)})
    for step in (1, 3, 7, 11, 29):
        listed = [*tried[::step], "a.test.ts", "/r/s/aTest.ts", "/r/A.Tests.ts", "/r/s/a.spec.md"]
        known = set(listed)
        got = JN.pair_tests(spark.createDataFrame([(f, "/r") for f in files], "path string, root string"), spark.createDataFrame([(n,) for n in listed], "path string"))
        assert {r.path: r.test_path for r in got.collect()} == {f: next((n for n in names(f) if n in known), None) for f in files}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def corpus(spark, *rows):
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_markers(spark):
    c = corpus(
        spark,
        ("/a.ts", "typescript", "x\n// todo: hack HACK\n/* HACK */\nthrow new Error('Not implemented')\nthrow new NotImplementedException()"),
        ("/a.cs", "csharp", "throw new NotImplementedException();\n//XXX"),
    )
    got = {(r.path, r.line): (r.type, r.column, r.length) for r in LX.marker_violations(c).collect()}
    assert got == {
        ("/a.ts", 2): ("todo_placeholder", 1, 7),
        ("/a.ts", 3): ("tech_debt_marker", 1, 7),
        ("/a.ts", 4): ("unimplemented_stub", 1, 32),
        ("/a.cs", 1): ("unimplemented_stub", 1, 34),
        ("/a.cs", 2): ("tech_debt_marker", 1, 5),
    }


CS = """using System;
using App.Core;
public class Order : BaseOrder, IShip<Item>
{
    private Customer _c;
    public List<Invoice> Lines { get; }
    public Order(int a, int b, int c, int d, int e, int f) { }
    public Receipt Pay(Card card) { try { var t = new Token(42); } catch (Exception e) { } return null; }
    // new Hidden()
}
"""


def test_csharp(spark):
    c = corpus(spark, ("/o.cs", "csharp", CS))
    assert {r.type_name for r in LX.referenced_types(c).collect()} >= {"BaseOrder", "IShip", "Customer", "Invoice", "Receipt", "Card", "Token"}
    assert "Hidden" not in {r.type_name for r in LX.referenced_types(c).collect()}
    assert LX.defined_types(c).first().type_names == ["Order"]
    got = {r.type: r.occurrences for r in LX.csharp_violations(c).collect()}
    assert got == {"tight_coupling": 1, "magic_number": 1, "empty_catch": 1}
    m = LX.lexical_metrics(c).first()
    assert (m.loc, m.classes, m.imports) == (11, 1, 2)
    assert [r.spec for r in LX.extract_imports(c).collect()] == ["System", "App.Core"]


def test_imports_and_relations(spark):
    src = "import Foo, { bar as baz } from './foo'\nimport * as util from './util';\nimport 'side';\nconst y = require('pkg');\nclass A extends Foo implements baz {}\nutil.run();\nbaz( 1 )\n"
    c = corpus(spark, ("/r/a.ts", "typescript", src))
    assert [r.spec for r in LX.extract_imports(c).orderBy("i").collect()] == ["./foo", "./util", "side", "pkg"]
    listing = spark.createDataFrame([("/r/foo.ts",), ("/r/util.ts",)], "path string")
    got = {(r.target, r.type, r.rationale, r.weight) for r in LX.enriched_relations(c, listing).collect()}
    assert got == {
        ("/r/util.ts", "FUNCTION_CALL", "calls util (first at line 6)", 2.0),
        ("/r/foo.ts", "FUNCTION_CALL", "calls baz (first at line 7)", 2.0),
        ("/r/foo.ts", "CLASS_EXTENDS", "A extends Foo", 3.0),
        ("/r/foo.ts", "IMPLEMENTS", "A implements baz", 3.0),
    }


def test_class_relations_take_plain_bases_only(spark):
    src = "import { Foo, Bar, ns } from './foo'\nclass A extends ns.Foo implements Bar.Inner, Foo {}\nconst B = class extends Foo {}\nexport default class extends Bar {}\nmake(class Named extends Bar {})\n"
    c = corpus(spark, ("/r/a.ts", "typescript", src))
    got = {r.rationale for r in LX.enriched_relations(c, spark.createDataFrame([("/r/foo.ts",)], "path string")).collect() if "CALL" not in r.type}
    assert got == {"A implements Foo", "<expr> extends Foo", "<anonymous> extends Bar", "<expr> extends Bar"}


def test_why_comments(spark):
    text = "a // WHY: speed\n/**\n * @tag nothing here\n * Loads the whole table.\n */\nx\n/** short */\n/**\n * Second block summary */"
    got = {(r.id, r.text) for r in LX.why_comments(corpus(spark, ("/a.ts", "typescript", text))).collect()}
    assert got == {("/a.ts:1:why", "speed"), ("/a.ts:2:jsdoc", "Loads the whole table."), ("/a.ts:8:jsdoc", "Second block summary")}


def test_callers(spark):
    c = corpus(spark, ("/a.test.ts", "typescript", "  run (1)\nrunner(2)\nobj.run()"))
    got = [(r.line, r.column, r.snippet, r.is_test) for r in LX.find_callers(c, spark.createDataFrame([("run",)], "symbol string")).orderBy("line").collect()]
    assert got == [(1, 3, "run (1)", True), (3, 5, "obj.run()", True)]


@pytest.mark.parametrize("scan", [LX.react_violations, LX.csharp_violations, LX.referenced_types])
def test_scans_read_the_texts_once(spark, scan):
    plan = scan(corpus(spark, ("/o.cs", "csharp", CS)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert "Join" not in plan and "Union" not in plan


def test_quick_patterns_find_the_same(spark):
    r = random.Random(3)
    parts = ["public", "private", "pubpublic", " ", "x", "List<int>", "(", "_", "12", "0", "7", ".5", "é34", '"', "use", "useState", "$useA", ".useB", "<T>", "on", "onClick", "=", "{", "async ", "function", "() =>"]
    texts = [("".join(r.choice(parts) for _ in range(r.randrange(1, 60))),) for _ in range(3000)] + [("public int Run(",), ("<a onClick={() => 1} useState<T>(1)",)]
    d = spark.createDataFrame(texts, "t string")
    handler = r"\bon\w+\s*=\s*\{\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>|\bon\w+\s*=\s*\{\s*(?:async\s+)?function\b"
    for old, new, g in (
        (RT.CS_GOD_METHOD, RT.CS_GOD_METHOD_FAST, 0),
        (RT.CS_MAGIC_NUMBER, RT.CS_MAGIC_NUMBER_FAST, 1),
        (handler, LX.HANDLER, 0),
        (r"(?<![\w$.])(use[A-Z]\w*)\s*(?:<[^>()]*>)?\(", LX.HOOK, 1),
    ):
        both = d.select(F.regexp_extract_all("t", F.lit(old), g).alias("a"), F.regexp_extract_all("t", F.lit(new), g).alias("b"))
        assert both.filter("a <> b").count() == 0 and both.filter("size(a) > 0").count() > 0


def test_react_and_types(spark):
    src = "const A = () => { useState(); useState(); return <a onClick={() => go()} onBlur={save} /> }\nlet x: any = 1; console.log(x); console.warn(x)"
    c = corpus(spark, ("/a.tsx", "tsx", src))
    assert {(r.type, r.n) for r in LX.react_violations(c).collect()} == {("inline_handler", 1), ("duplicate_hooks", 1)}
    assert {(r.type, r.matches) for r in LX.scan_rules(c, LX.TYPE_RULES).collect()} == {("any_type", 1), ("console_log", 1)}
    assert {(r.type, r.matches) for r in LX.scan_rules(c, LX.SNIPPET_TYPE_RULES).collect()} == {("any_usage", 1), ("console_log", 2)}


def test_spans_and_snippets(spark):
    s = one(spark, X.offset_to_span(F.col("c"), F.lit(5), F.lit(4)), c="ab\ncdef\ngh")
    assert tuple(s) == (2, 3, 3, 2, 5, 4)
    assert one(spark, X.snippet(F.col("c"), F.lit(2), F.lit(2)), c="a\nb\nc\nd") == "a\nb\nc"
    assert one(spark, X.fix_text(F.col("f")), f='{"description":"do it"}') == "do it"
    assert one(spark, X.fix_text(F.col("f")), f="plain") == "plain"


def test_blobs(spark):
    blob = {
        "path": "/a.ts", "language": "typescript", "rating": 7.5, "analyzedAt": 1700000000123, "repoRoot": "/r", "metrics": {"linesOfCode": 3},
        "dependencies": [{"source": "/a.ts", "target": "/b.ts", "type": "import", "weight": 1}],
        "violations": [{"type": "x", "severity": "info", "message": "m", "fix": "text"}, {"type": "y", "severity": "error", "message": "m", "fix": {"description": "d", "confidence": "deterministic"}}],
    }
    r = TB.from_blob(spark.createDataFrame([(json.dumps(blob),)], "data string")).first()
    assert (r.repo, r.path, r.metrics.linesOfCode) == ("/r", "/a.ts", 3)
    assert [v.fix.description for v in r.violations] == ["text", "d"] and r.violations[1].fix.confidence == "deterministic"
    ordered = TB.from_blob(spark.createDataFrame([(json.dumps(blob),)], "data string")).select(R.prioritise(F.col("violations")).alias("v")).first().v
    assert [v.type for v in ordered] == ["y", "x"]


def test_blobs_of_files_without_violations(spark, sf, tmp_path):
    import __spark_entry__ as entry

    for name in ("part", "lineitem"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        t.where("true" if name == "part" else "l_partkey % 3 > 0").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = entry.queries()["analysis_blobs"](spark, str(tmp_path)).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    bare = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 3 = 0").count()
    assert bare and sum(r.n_violations == 0 for r in rows) >= bare
    assert all((r.first_fix is None) == (r.n_violations == 0) for r in rows)


def test_merge_graphs(spark):
    n = lambda rows: spark.createDataFrame([(i, i, r) for i, r in rows], "id string, label string, rating double")
    e = lambda rows: spark.createDataFrame([(s, t, "import", 1.0) for s, t in rows], "source string, target string, type string, strength double")
    out = MG.merge_graphs(n([("a", 8.0), ("b", 6.0)]), e([("a", "b")]), n([("b", 5.0), ("c", 9.0)]), e([("b", "c"), ("a", "b")]))
    assert {r.id: r.rating for r in out["nodes"].collect()} == {"a": 8.0, "b": 5.0, "c": 9.0}
    assert out["edges"].count() == 2 and [(r.id, r.resolved) for r in out["conflicts"].collect()] == [("b", 5.0)]


def test_replace_repos(spark):
    old = spark.createDataFrame([("a", "a:1"), ("b", "b:1")], "prefix string, id string")
    new = spark.createDataFrame([("a", "a:2")], "prefix string, id string")
    assert {r.id for r in MG.replace_repos(old, new).collect()} == {"a:2", "b:1"}


def test_patterns(spark):
    v = spark.createDataFrame(
        [("/a", "any_type", "info"), ("/a", "any_type", "warning"), ("/b", "any_type", "info"), ("/b", "odd", "error")], "path string, type string, severity string"
    )
    got = {r.violation_type: r for r in PT.violation_patterns(v).collect()}
    assert (got["any_type"].severity, got["any_type"].file_count, got["any_type"].total_occurrences, got["any_type"].estimated_gain) == ("warning", 2, 3, 1.5)
    assert got["odd"].suggestion == "Fix all odd occurrences codebase-wide."


def test_upsert_table(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "repo string, path string, rating double, analyzedAt timestamp, seq long").withColumn(
        "analyzedAt", F.timestamp_seconds(F.col("seq")))
    target = str(tmp_path / "t")
    ST.write_upsert(rows(("a", "x", 1.0, None, 5), ("b", "y", 2.0, None, 1)), target)
    ST.write_upsert(rows(("a", "x", 9.0, None, 3), ("a", "z", 3.0, None, 6)), target)
    got = {(r.repo, r.path): r.rating for r in spark.read.parquet(target).collect()}
    assert got == {("a", "x"): 1.0, ("a", "z"): 3.0, ("b", "y"): 2.0}  # the older write does not win


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "repo string, path string, rating double, seq long").withColumn("analyzedAt", F.timestamp_seconds("seq"))
    target = tmp_path / "t"
    ST.write_upsert(rows([("a", f"f{i}", 1.0, 1) for i in range(200)]), str(target))
    files = lambda: {p.parent.name: p.name for p in target.rglob("*.parquet")}
    before = files()
    assert len(before) == ST.BUCKETS
    for _ in range(2):  # the second time is the same batch run again
        ST.write_upsert(rows([("a", "f7", 5.0, 2)]), str(target))
        after = files()
        assert set(after) == set(before) and sum(after[b] != before[b] for b in before) == 1
        got = {r.path: r.rating for r in spark.read.parquet(str(target)).collect()}
        assert got == {f"f{i}": 5.0 if i == 7 else 1.0 for i in range(200)}


def test_export_escapes(spark, tmp_path):
    n = spark.createDataFrame([("/a&<\"'.ts", "a", 7.0, 10, 2, 0)], "id string, label string, rating double, loc int, complexity int, imports int")
    e = spark.createDataFrame([("x", "y", "type-ref", 2.0)], "source string, target string, type string, strength double")
    xml = [r.line for r in EX.graphml_lines(n, e).orderBy("section", "key", "ord").collect()]
    assert '    <node id="/a&amp;&lt;&quot;\'.ts">' in xml and xml[-1] == "</graphml>"
    cypher = [r.line for r in EX.cypher_lines(n, e).orderBy("section", "key", "ord").collect()]
    assert any("CREATE (a)-[:TYPE_REF {weight: 2}]->(b);" in x for x in cypher)
    assert any("id: '/a&<\"\\'.ts'" in x for x in cypher)
    EX.write_lines(EX.graphml_lines(n, e), str(tmp_path / "g"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "g")).collect()) == sorted(xml)


def test_intents(spark):
    q = lambda t, i=None: one(spark, X.route_question(F.col("t"), i), t=t)
    assert q("what would break if I change x") == "impact"
    assert q("which files connect a to b") == "path"
    assert q("hello") == "unrecognised"
    assert q("worst files", X.PROMPT_INTENTS) == "health / quality"


def test_hints(spark):
    v = spark.createDataFrame([("/a", "god_class", "warning"), ("/a", "weird", "error")], "path string, type string, severity string")
    m = spark.createDataFrame([("/a", 31)], "path string, imports int")
    c = spark.createDataFrame([("/a", 2)], "path string, n_cycles int")
    rows = PT.refactoring_hints(v, m, c).orderBy(F.desc("gain"), "priority_rank").collect()
    assert [(r.violation_type, r.gain) for r in rows] == [("circular_dependency", 2.0), ("high_import_count", 2.0), ("god_class", 0.5)]
