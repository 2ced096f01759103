"""Graph operators: small goldens, and random graphs against plain Python."""

import math
import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from estatelens.operators import centrality as CE
from estatelens.operators import components as CO
from estatelens.operators import coupling as CU
from estatelens.operators import ordering as OR
from estatelens.operators import risk as RK
from estatelens.operators import traverse as TR

NODES = {"a": 9.0, "b": 5.0, "c": 7.0, "d": 4.0, "e": 8.0, "f": 6.0}
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "f")]


def frames(spark, nodes, edges, repo="/r"):
    n = spark.createDataFrame([(repo, k, k, v) for k, v in nodes.items()], "repo string, id string, label string, rating double")
    e = spark.createDataFrame([(s, t, "import", 1.0) for s, t in edges], "source string, target string, type string, strength double")
    return n, e


def random_graph(seed, n, m):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    nodes = {x: r.randrange(0, 101) / 10 for x in names}
    edges = {(r.choice(names), r.choice(names)) for _ in range(m)}
    return nodes, sorted(edges)


def dependents(edges, root, depth):
    back = {}
    for s, t in edges:
        back.setdefault(t, []).append(s)
    seen, queue = {root: 0}, deque([root])
    while queue:
        x = queue.popleft()
        if seen[x] == depth:
            continue
        for y in back.get(x, []):
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return {k: v for k, v in seen.items() if k != root}


def test_impact_golden(spark):
    n, e = frames(spark, NODES, EDGES)
    roots = spark.createDataFrame([("d",)], "root string")
    got = {r.path: (r.depth, r.severity, r.fragile) for r in TR.impact_set(e, n, roots).collect()}
    assert got == {"b": (1, "direct", True), "c": (1, "direct", False), "a": (2, "indirect", False)}
    assert TR.impact_set(e, n, spark.createDataFrame([("a",)], "root string")).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_impact_random(spark, depth):
    nodes, edges = random_graph(depth, 20, 40)
    n, e = frames(spark, nodes, edges)
    got = {(r.root, r.path): r.depth for r in TR.impact_set(e, n, n.select(F.col("id").alias("root")), depth).collect()}
    want = {(r, p): d for r in nodes for p, d in dependents(edges, r, depth).items()}
    assert got == want


def test_unknown_rating_counts_as_ten(spark):
    n, e = frames(spark, {"a": 3.0}, [("x", "a")])
    row = TR.impact_set(e, n, spark.createDataFrame([("a",)], "root string")).first()
    assert (row.rating, row.fragile) == (10.0, False)


def test_hot_nodes_are_salted(spark, monkeypatch):
    nodes, edges = random_graph(3, 20, 40)
    edges = sorted(set(edges) | {(x, "n00") for x in nodes if x != "n00"})
    n, e = frames(spark, nodes, edges)
    real = TR._hot
    monkeypatch.setattr(TR, "_hot", lambda links, column, total: real(links, column, 100_000) or spark.createDataFrame(
        [(r[0],) for r in links.groupBy(column).count().filter("count > 5").select(column).collect()], "node long"))
    g = TR.number_graph(e)
    assert g.hot_dst is not None and g.links.df.select("dst_salt").distinct().count() > 1
    got = {(r.root, r.path): r.depth for r in TR.impact_set(e, n, n.select(F.col("id").alias("root")), 5).collect()}
    assert got == {(r, p): d for r in nodes for p, d in dependents(edges, r, 5).items()}


@pytest.mark.parametrize("few_sources", [False, True])
def test_shortest_paths(spark, few_sources):
    nodes, edges = random_graph(7, 18, 30)
    n, e = frames(spark, nodes, edges)
    pairs = [(b, a) if few_sources else (a, b) for a in nodes for b in list(nodes)[:6]]
    got = {(r.source, r.target): r for r in TR.shortest_paths(e, n, spark.createDataFrame(pairs, "source string, target string")).collect()}

    def path(a, b):
        if a == b:
            return [a]
        best, queue = {}, deque([[a]])
        level = [[a]]
        seen = {a}
        while level:
            nxt = {}
            for p in sorted(level):
                for s, t in edges:
                    if s == p[-1] and t not in seen:
                        nxt.setdefault(t, p + [t])
            if b in nxt:
                return nxt[b]
            seen |= set(nxt)
            level = list(nxt.values())
        return None

    for a, b in pairs:
        r, f, back = got[(a, b)], path(a, b), path(b, a)
        assert r.direction == ("forward" if f else "reverse" if back else "none")
        assert r.path == (f or back)
        if f:
            assert r.bottlenecks == sum(nodes[x] < 6 for x in f)


def brandes(nodes, edges):
    adj = {}
    for s, t in edges:
        adj.setdefault(s, []).append(t)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, pred, sigma, dist = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, -1)
        sigma[s], dist[s] = 1, 0
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj.get(v, []):
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_betweenness(spark):
    n, e = frames(spark, {"a": 1.0, "b": 1.0, "c": 1.0}, [("a", "b"), ("b", "c")])
    got = {r.path: (r.betweenness, r.normalized_betweenness) for r in CE.betweenness(e, n).collect()}
    assert got == {"a": (0, 0), "b": (1.0, 0.5), "c": (0, 0)}
    nodes, edges = random_graph(11, 15, 35)
    edges = edges + edges[:3]  # parallel edges count as separate paths
    n, e = frames(spark, nodes, edges)
    got = {r.path: r.betweenness for r in CE.betweenness(e, n).collect()}
    want = brandes(nodes, edges)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in nodes)


def test_betweenness_goes_back_from_written_levels(spark, monkeypatch):
    nodes = {f"n{i}": 1.0 for i in range(6)}
    edges = [(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n0", "n2"), ("n1", "n3")]
    n, e = frames(spark, nodes, edges)
    plans, real = [], TR.NumberedGraph.dependents
    monkeypatch.setattr(TR.NumberedGraph, "dependents", lambda g, f, *a: plans.append(f._jdf.queryExecution().optimizedPlan().toString()) or real(g, f, *a))
    got = {r.path: r.betweenness for r in CE.betweenness(e, n).collect()}
    want = brandes(nodes, edges)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in nodes)
    assert len(plans) >= 3 and not any("Join" in p for p in plans)


def test_sampled_betweenness_keeps_its_error(spark):
    nodes, edges = random_graph(3, 120, 260)
    edges = [(s, t) for s, t in edges if s != t]
    n, e = frames(spark, nodes, edges)
    drawn = CE.sampled_sources(n, 0.25, 0.1).collect()
    assert 10 < len(drawn) < 80 and all(abs(r.weight * len(drawn) - len(nodes)) < 1e-9 for r in drawn)
    want, scale = brandes(nodes, edges), (len(nodes) - 1) * (len(nodes) - 2)
    got = {r.path: r.normalized_betweenness for r in CE.sampled_betweenness(e, n, 0.25, 0.1).collect()}
    assert set(got) == set(nodes) and all(abs(got[x] - want[x] / scale) <= 0.25 for x in nodes)
    # A tight bound draws every file, and the estimate is exact.
    whole = {r.path: r.betweenness for r in CE.sampled_betweenness(e, n, 0.01, 0.1).collect()}
    assert all(abs(whole[x] - want[x]) < 1e-6 for x in nodes)


@pytest.mark.parametrize("seed,m", [(1, 60), (2, 110), (5, 300)])
def test_closure_sizes(spark, seed, m):
    nodes, edges = random_graph(seed, 60, m)
    edges += [("n00", "gone")]  # a file that the node table does not know
    n, e = frames(spark, nodes, edges)
    want = {x: 0 for x in nodes}
    for x in nodes:
        seen, queue = set(), deque([x])
        while queue:
            y = queue.popleft()
            for s, t in edges:
                if t == y and s not in seen:
                    seen.add(s)
                    queue.append(s)
        want[x] = len(seen)
    got = {r.path: (r.dependents, r.exact) for r in TR.closure_sizes(e, n).collect()}
    assert got == {x: (k, True) for x, k in want.items()}
    rough = {r.path: r for r in TR.closure_sizes(e, n, 4).collect()}
    assert all(rough[x].dependents == k for x, k in want.items() if k < 16)
    assert all(abs(rough[x].dependents - k) <= 4 * k / 15**0.5 and not rough[x].exact for x, k in want.items() if k > 32)


def components(nodes, edges):
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for s, t in edges:
            reach[s] |= reach[t]
    for s, t in edges:
        pass
    out = {}
    for x in nodes:
        mates = {y for y in reach[x] if x in reach[y]}
        if len(mates) > 1 or (x, x) in edges:
            out[x] = (min(mates), len(mates))
    return out


@pytest.mark.parametrize("seed,m", [(1, 18), (2, 25), (3, 60)])
def test_components(spark, seed, m):
    nodes, edges = random_graph(seed, 22, m)
    _, e = frames(spark, nodes, edges)
    got = {r.path: (r.component, r.size) for r in CO.strong_components(e).collect()}
    assert got == components(nodes, edges)


def test_chains_between_and_inside_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "p"), ("p", "q"), ("q", "x"), ("x", "y"), ("y", "x"), ("x", "w"), ("w", "y")]
    edges += [("h", "i"), ("i", "j"), ("j", "h"), ("h", "k"), ("k", "h"), ("r", "s"), ("s", "t"), ("t", "r")]
    _, e = frames(spark, {}, edges)
    got = {r.path: (r.component, r.size) for r in CO.strong_components(e).collect()}
    assert got == components(sorted({x for p in edges for x in p}), edges)


@pytest.mark.parametrize("tail", [False, True])
def test_a_long_cycle_takes_few_rounds(spark, monkeypatch, tail):
    size = 10_000
    e = spark.range(size).select(F.format_string("f%05d", "id").alias("source"), F.format_string("f%05d", (F.col("id") + 1) % size).alias("target"))
    if tail:
        e = e.union(spark.createDataFrame([("f00000", "f05000"), ("f00001", "f05001")], "source string, target string"))
    rounds, real = [], CO.materialize
    monkeypatch.setattr(CO, "materialize", lambda *a, **k: rounds.append(1) or real(*a, **k))
    got = CO.strong_components(e).groupBy("component", "size").count().collect()
    assert [tuple(r) for r in got] == [("f00000", size, size)]
    assert len(rounds) <= 40


def test_elementary_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "d")]
    _, e = frames(spark, {}, edges)
    got = sorted(r.cycle for r in CO.elementary_cycles(e, CO.strong_components(e), 4).collect())
    assert got == [["a", "b"], ["a", "b", "c"], ["d"]]


def topo(nodes, edges):
    deps = {x: {t for s, t in edges if s == x and t != x and t in nodes} for x in nodes}
    level, out = 0, {}
    while deps:
        ready = [x for x in deps if not deps[x]] or [min((x for x in deps if deps[x]), key=lambda x: (nodes[x], x))]
        for x in ready:
            out[x] = level
            del deps[x]
        for d in deps.values():
            d.difference_update(ready)
        level += 1
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_fix_order(spark, seed):
    nodes, edges = random_graph(seed, 20, 30)
    n, e = frames(spark, nodes, edges)
    got = {r.path: r.level for r in OR.fix_order(e, n).collect()}
    assert got == topo(nodes, edges)


def test_many_stalls_take_few_rounds(spark, monkeypatch):
    nodes, edges = random_graph(7, 60, 150)
    pairs = {f"p{i:03d}{side}": float(i % 7) for i in range(100) for side in "ab"}
    loops = [(f"p{i:03d}{x}", f"p{i:03d}{y}") for i in range(100) for x, y in ("ab", "ba")]
    n1, e1 = frames(spark, nodes, edges, "/r")
    n2, e2 = frames(spark, pairs, loops, "/s")
    rounds, real = [], OR.materialize
    monkeypatch.setattr(OR, "materialize", lambda *a, **k: rounds.append(1) or real(*a, **k))
    got = {r.path: r.level for r in OR.fix_order(e1.union(e2), n1.union(n2)).collect()}
    assert got == topo(nodes, edges) | topo(pairs, loops)  # 100 stalls and 200 levels in /s
    assert len(rounds) <= 60


def test_placed_files_leave_the_rounds_of_a_fix_order(spark, monkeypatch):
    nodes = {f"f{i:03d}": float(i % 9) for i in range(200)}
    edges = [(f"f{i + 1:03d}", f"f{i:03d}") for i in range(6)]  # all but 6 files are ready in the first round
    read, real = [], OR._without
    monkeypatch.setattr(OR, "_without", lambda files, links, placed: read.append(files.count()) or real(files, links, placed))
    n, e = frames(spark, nodes, edges)
    assert {r.path: r.level for r in OR.fix_order(e, n).collect()} == topo(nodes, edges)
    assert sum(r == 200 for r in read) <= 2


def test_fix_order_golden(spark):
    n, e = frames(spark, {"a": 8.0, "b": 2.0, "c": 5.0}, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "zz")])
    order = [r.path for r in OR.fix_order(e, n).orderBy("level", "rating", "path").collect()]
    assert order[0] == "b" and sorted(order) == ["a", "b", "c"]


def test_layers_share_a_cycle(spark):
    n, e = frames(spark, {x: 5.0 for x in "abcd"}, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "a")])
    assert {r.path: r.layer for r in OR.layers(e, n).collect()} == {"c": 0, "a": 1, "b": 1, "d": 2}


def test_remediation_plan(spark):
    n, e = frames(spark, {"root": 9.0, "x": 4.0, "y": 3.0, "z": 8.0}, [("x", "root"), ("y", "x"), ("z", "root")])
    v = spark.createDataFrame(
        [
            ("x", "any_type", "warning", 3, ("d", "unknown", "deterministic")),
            ("x", "empty_catch", "error", 9, ("d", None, None)),
            ("y", "console_log", "info", 1, ("d", None, "deterministic")),
        ],
        "path string, type string, severity string, line int, fix struct<description string, replacement string, confidence string>",
    )
    got = OR.remediation_plan(e, n, v, spark.createDataFrame([("root",)], "root string")).orderBy("step").collect()
    # 0.5 for a sure fix and 1.5 / 3 for an unsure one are equal: the type decides
    assert [(r.step, r.path, r.rule, r.action, r.replacement) for r in got] == [
        (0, "x", "any_type", "replace", "unknown"),
        (1, "y", "console_log", "manual", None),
    ]
    assert got[0].total_gain == 0.6


def test_transitive_dependents_keep_a_root_on_a_cycle(spark):
    n, e = frames(spark, {"a": 1.0, "b": 9.0}, [("a", "b"), ("b", "a")])
    got = {(r.root, r.path, r.direct) for r in TR.transitive_dependents(e, n, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", "b", True), ("a", "a", False)}


PR_NODES = {"auth": 8.0, "db": 4.0, "utils": 9.0, "api": 7.0, "middleware": 5.0}
PR_EDGES = [("api", "auth"), ("middleware", "auth"), ("auth", "db"), ("api", "utils")]


def test_review(spark):
    n, e = frames(spark, PR_NODES, PR_EDGES)
    changed = spark.createDataFrame([(1, "auth"), (1, "db"), (2, "utils"), (2, "gone")], "pr int, path string")
    a = RK.assess_changed_files(e, n, changed)
    got = {r.path: (r.verdict, r.direct_dependents, r.fragile_impacted, r.reasons) for r in a.collect()}
    assert got["db"][0] == "RED" and got["db"][3][0] == "Low quality file (rating 4/10)"
    assert got["auth"] == ("YELLOW", 2, 1, ["1 fragile dependent(s) may be impacted"])
    assert got["utils"] == ("GREEN", 1, 0, ["Healthy file (rating 9/10)"])
    assert got["gone"] == ("GREEN", 0, 0, ["Not yet analyzed"])
    v = {r.pr: r.overall_verdict for r in RK.review_verdicts(changed, a).collect()}
    assert v == {1: "RED", 2: "GREEN"}


def test_comment_counts_overlap(spark):
    s = spark.createDataFrame([(1, 4.0, 1), (1, 9.0, 0)], "pr int, rating double, fragile_dependents int")
    r = RK.comment_verdicts(s).first()
    assert (r.high, r.medium, r.low, r.verdict) == (1, 1, 1, "request-changes")
    assert [x.risk for x in RK.comment_rows(s).orderBy("rating").collect()] == ["HIGH", "LOW"]


def test_push_summaries_match_by_suffix(spark):
    n = spark.createDataFrame(
        [("/r/src/a.ts", 8.0, 1, 0), ("/r/lib/xa.ts", 3.0, 0, 2), ("/r/src/b.ts", 5.0, 0, 0)], "id string, rating double, errors int, warnings int"
    )
    e = spark.createDataFrame([("/r/src/b.ts", "/r/src/a.ts")], "source string, target string")
    f = spark.createDataFrame([("a.ts",), ("src/b.ts",), ("none.ts",)], "file string")
    got = {r.file: (r.id, r.direct_dependents, r.fragile_dependents) for r in RK.push_summaries(f, e, n).collect()}
    assert got == {"a.ts": ("/r/src/a.ts", 1, 1), "src/b.ts": ("/r/src/b.ts", 0, 0)}


def test_surprising(spark):
    paths = ["src/auth/login.ts", "src/auth/token.ts", "src/database/db.ts", "src/utils/x.ts", "src/utils/y.ts", "index.ts"]
    n, e = frames(
        spark,
        {f"/repo/{p}": 5.0 for p in paths},
        [("/repo/src/auth/login.ts", "/repo/src/auth/token.ts"), ("/repo/src/auth/login.ts", "/repo/src/database/db.ts"), ("/repo/src/utils/x.ts", "/repo/src/auth/token.ts"), ("/repo/src/utils/y.ts", "/repo/src/auth/token.ts")],
        repo="/repo",
    )
    rows = CU.surprising(e, n, 10).orderBy("rank").collect()
    assert rows[0].target == "/repo/src/database/db.ts" and rows[0].source_module == "auth"
    assert rows[0].explanation == "auth → database (1 cross-edge, distance 2)"
    assert len(rows) == 3 and rows[1].pair_count == 2


@pytest.mark.parametrize("mode", ["distance", "inverse"])
def test_surprising_shuffles_the_edges_once_for_each_end(spark, mode):
    rng, ids = random.Random(3), [f"/r/m{i % 7}/{'d/' * (i % 3)}f{i}.ts" for i in range(60)]
    n = spark.createDataFrame([("/r", i, 5.0) for i in ids], "repo string, id string, rating double").localCheckpoint()
    e = [(rng.choice(ids), rng.choice([*ids, "/r/unknown.ts"])) for _ in range(500)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = CU.surprising(spark.createDataFrame(e, "source string, target string").localCheckpoint(), n, 5, mode=mode)
        got = [(r.source, r.target, r.pair_count, round(r.score, 9)) for r in sorted(df.collect(), key=lambda r: r["rank"])]
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    module, known = lambda p: p.split("/")[2], set(ids)
    across = [(s, t) for s, t in e if t in known and module(s) != module(t)]
    counts = Counter((module(s), module(t)) for s, t in across)

    def score(s, t):
        x, y = s.split("/")[:-1], t.split("/")[:-1]
        common = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        return round((len(x) + len(y) - 2 * common if mode == "distance" else 1) / math.log(counts[module(s), module(t)] + 1), 9)

    want = sorted(((-score(s, t), s, t) for s, t in set(across)))[:5]
    assert got == [(s, t, counts[module(s), module(t)], -x) for x, s, t in want]
    exchanges = re.findall(r"^[\s:+-]*Exchange hashpartitioning\((source|target)#", text, re.M)
    assert sorted(exchanges) == ["source", "source", "target", "target"]  # of the edges and of the files


def test_adjacency_chunks_keep_every_neighbour(spark):
    _, e = frames(spark, {}, [("god", f"n{i}") for i in range(25)] + [("a", "b")])
    rows = [r for r in CE.adjacency(e, chunk=10).collect() if r.path == "god"]
    assert len(rows) > 1 and sorted(x for r in rows for x in r.neighbours) == sorted(f"n{i}" for i in range(25))


def test_rank(spark):
    n, e = frames(spark, NODES, EDGES)
    d = CE.degree_centrality(e, n)
    got = {r.path: r["rank"] for r in CE.centrality_rank(d, n.select(F.col("id").alias("path"))).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}


@pytest.mark.parametrize("query,tag", [("closure_sizes", "closure"), ("transitive_dependents", "level")])
def test_closures_walk_between_components(spark, monkeypatch, query, tag):
    ring = [f"n{i:02d}" for i in range(12)]
    edges = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])] + [("x", "n00"), ("n05", "y")]
    n, e = frames(spark, {x: 5.0 for x in [*ring, "x", "y"]}, edges)
    written, write = [], TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda df, name="stage", **more: written.append(name) or write(df, name, **more))
    if query == "closure_sizes":
        got = {r.path: r.dependents for r in TR.closure_sizes(e, n).collect()}
        assert got == {**{x: 13 for x in ring}, "x": 0, "y": 13}
    else:
        monkeypatch.setattr(TR, "SLICE", 5)
        rows = TR.transitive_dependents(e, n, n.select(F.col("id").alias("root"))).select("root", "path", "direct").collect()
        want = {(r, p) for r in [*ring, "y"] for p in [*ring, "x"]}
        assert len(rows) == len(want) and {(r.root, r.path) for r in rows} == want
        assert {(r.path, r.root) for r in rows if r.direct} == set(edges)
    assert written.count(tag) <= 4  # one for each file of the ring before


def test_closure_sizes_count_what_depends_on_a_hub_once(spark, monkeypatch):
    """A ring that depends on y0 to y9; x depends on the ring and on o, which depends on y0, z on x; p depends on y1 alone."""
    ring = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])] + [("n05", f"y{i}") for i in range(10)] + [("y3", "y4")]
    edges += [("x", "n00"), ("x", "o"), ("o", "y0"), ("z", "x"), ("p", "y1"), ("q", "y4")]
    names = sorted({x for e in edges for x in e})
    n, e = frames(spark, {x: 5.0 for x in names}, edges)
    largest, write = [], TR.materialize

    def noted(df, name="stage", **more):
        out = write(df, name, **more)
        if name == "closure" and out.rows:
            largest.append(out.df.agg(F.max(F.theta_sketch_estimate("sketch"))).first()[0])
        return out

    monkeypatch.setattr(TR, "materialize", noted)
    got = {r.path: r.dependents for r in TR.closure_sizes(e, n).collect()}
    want = {**{x: 42 for x in [*ring, *(f"y{i}" for i in range(10))]}, "x": 1, "z": 0, "o": 2, "p": 0, "q": 0, "y0": 43, "y1": 43, "y4": 44}
    assert got == want
    assert max(largest) <= 3  # the 42 files of the ring and above it are in no sketch


@pytest.mark.parametrize("wide", [256, 1])
def test_pairs_of_files_are_not_joined_again(spark, monkeypatch, wide):
    monkeypatch.setattr(TR, "WIDE", wide)
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("c", "b"), ("c", "d"), ("a", "d")]
    n, e = frames(spark, {x: 5.0 for x in "abcd"}, edges)
    df = TR.transitive_dependents(e, n, n.select(F.col("id").alias("root")))
    got = {(r.root, r.path, r.direct) for r in df.collect()}
    assert got == {(t, s, (s, t) in edges) for t, s in [*((t, s) for t in "abd" for s in "abc")]}
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    again = re.findall(r"Left keys \[2\]: \[r#\d+L, p#\d+L\]|Arguments: \[r#\d+L, p#\d+L\]", text)
    assert bool(again) == (wide == 1)


def test_few_roots_cut_the_graph_first(spark, monkeypatch):
    edges = [("b", "a"), ("c", "b")] + [(f"n{i}", f"n{(i + 1) % 30}") for i in range(30)] + [("b", "n3")]
    n, e = frames(spark, {x: 5.0 for x in sorted({x for k in edges for x in k})}, edges)
    from estatelens.operators import components as CO

    sizes, write = [], CO.materialize
    monkeypatch.setattr(CO, "materialize", lambda df, name="stage", **more: (lambda w: sizes.append((name, w.rows)) or w)(write(df, name, **more)))
    rows = TR.transitive_dependents(e, n, spark.createDataFrame([("a",)], "root string")).collect()
    assert {(r.root, r.path, r.direct) for r in rows} == {("a", "b", True), ("a", "c", False)}
    assert dict(sizes)["units"] == 3
