"""Catalogue: graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rating as R
from ..operators import centrality as CE
from ..operators import components as CO
from ..operators import coupling as CU
from ..operators import graph_build as GB
from ..operators import ordering as OR
from ..operators import reports as RP
from ..operators import risk as RK
from ..operators import traverse as TR
from ..sources import adapters as A
from .context import Catalogue
from .fragments import QUESTIONS as _QUESTIONS
from .fragments import base, js, with_parts

catalogue = Catalogue()
add = catalogue.add


@add("graph_nodes", with_parts("SELECT repo, id, label, language, rating, size, loc, complexity, imports, n_violations FROM nodes", "nodes"))
def _(t):
    return A.nodes(t.spark, t.sf).drop("errors", "warnings")


@add("graph_edges", with_parts("SELECT * FROM local", "local"))
def _(t):
    raw = A.raw_dependencies(t.spark, t.sf)
    return GB.first_wins(GB.known_targets(raw, t.nodes))


@add("first_wins_edges", with_parts("SELECT * FROM cross_e", "cross_e"))
def _(t):
    return GB.first_wins(A.raw_dependencies(t.spark, t.sf, ()))


@add(
    "type_resolution",
    with_parts(
        """SELECT DISTINCT r.source, o.owner AS target FROM raw_local r JOIN files s ON s.path = r.source JOIN files f ON f.path = r.target
        JOIN (SELECT repo, name, arg_min(path, part) AS owner FROM files GROUP BY 1, 2) o ON o.repo = s.repo AND o.name = f.name
        WHERE o.owner <> r.source""",
        "raw_local",
    ),
)
def _(t):
    name = F.element_at(F.split("target", "/"), -2)
    deps = A.raw_dependencies(t.spark, t.sf).select(
        "repo", "source", F.col("source").alias("path"), F.concat(F.lit("__type__:"), name).alias("target"), "type", "weight", "pos"
    )
    defined = t.files.select("repo", F.element_at(F.split("path", "/"), -2).alias("type_name"), "path", F.col("part").alias("pos"))
    return GB.resolve_types(deps, defined).select("source", "target").distinct()


@add(
    "known_edges",
    with_parts(
        """SELECT e.* FROM edges_f e WHERE target IN (SELECT id FROM nodes_o) AND source IN (SELECT id FROM nodes_o)""", "edges_f", "nodes_o"
    ),
)
def _(t):
    return GB.known_targets(t.snapshot("F")[1], t.snapshot("O")[0], both_ends=True).select("source", "target", "type", "strength")


@add(
    "rating_lookup",
    with_parts("SELECT source, target, coalesce(n.rating, 10.0) AS target_rating FROM edges_o e LEFT JOIN nodes_f n ON n.id = e.target", "edges_o", "nodes_f"),
)
def _(t):
    e = t.snapshot("O")[1].select("source", "target")
    return TR.with_rating(e, t.snapshot("F")[0], "target", "target_rating")


@add(
    "impact_set",
    with_parts(
        """SELECT root, path, depth, CASE depth WHEN 1 THEN 'direct' ELSE 'indirect' END AS severity, rating, rating < 6 AS fragile FROM impact2""", "impact2"
    ),
)
def _(t):
    return TR.impact_set(t.local, t.nodes, t.roots, 2)


@add(
    "impact_set_salted",
    with_parts(
        """SELECT root, path, depth, CASE depth WHEN 1 THEN 'direct' ELSE 'indirect' END AS severity, rating, rating < 6 AS fragile FROM impact2""", "impact2"
    ),
)
def _(t):
    return TR.impact_set(t.local, t.nodes, t.roots, 2, hot_share=1000)


@add(
    "impact_set_depth6",
    with_parts(
        """, worst6 AS (SELECT repo, arg_min(id, (rating, id)) AS root FROM nodes GROUP BY repo),
        r6 AS (SELECT root, root AS path, 0 AS depth FROM worst6
            UNION SELECT r6.root, e.source, r6.depth + 1 FROM r6 JOIN local e ON e.target = r6.path WHERE r6.depth < 6)
        SELECT root, path, CAST(min(depth) AS INT) AS depth, CASE min(depth) WHEN 1 THEN 'direct' ELSE 'indirect' END AS severity,
            any_value(coalesce(n.rating, 10.0)) AS rating, any_value(coalesce(n.rating, 10.0)) < 6 AS fragile
        FROM r6 LEFT JOIN nodes n ON n.id = r6.path WHERE path <> root GROUP BY root, path""",
        "local",
        "nodes",
    ),
)
def _(t):
    return TR.impact_set(t.local, t.nodes, t.worst.select(F.col("worst").alias("root")), 6)


@add(
    "impact_set_depth20",
    with_parts(
        """, worst6 AS (SELECT repo, arg_min(id, (rating, id)) AS root FROM nodes GROUP BY repo),
        r6 AS (SELECT root, root AS path, 0 AS depth FROM worst6
            UNION SELECT r6.root, e.source, r6.depth + 1 FROM r6 JOIN local e ON e.target = r6.path WHERE r6.depth < 20)
        SELECT root, path, CAST(min(depth) AS INT) AS depth, CASE min(depth) WHEN 1 THEN 'direct' ELSE 'indirect' END AS severity,
            any_value(coalesce(n.rating, 10.0)) AS rating, any_value(coalesce(n.rating, 10.0)) < 6 AS fragile
        FROM r6 LEFT JOIN nodes n ON n.id = r6.path WHERE path <> root GROUP BY root, path""",
        "local",
        "nodes",
    ),
)
def _(t):
    return TR.impact_set(t.local, t.nodes, t.worst.select(F.col("worst").alias("root")), 20)


@add(
    "impact_set_deep",
    with_parts(
        """SELECT root, path, depth, CASE depth WHEN 1 THEN 'direct' ELSE 'indirect' END AS severity, rating, rating < 6 AS fragile FROM impact3""", "impact3"
    ),
)
def _(t):
    return TR.impact_set(t.local, t.nodes, t.roots, 3)


@add(
    "transitive_dependents",
    with_parts(
        """, r AS (SELECT target AS root, source AS path FROM local UNION SELECT r.root, e.source FROM r JOIN local e ON e.target = r.path)
        SELECT r.root, r.path, d.source IS NOT NULL AS direct, n.rating, coalesce(n.rating < 6, false) AS at_risk
        FROM r JOIN nodes n ON n.id = r.path LEFT JOIN local d ON d.target = r.root AND d.source = r.path""",
        "local",
        "nodes",
    ),
)
def _(t):
    return TR.transitive_dependents(t.local, t.nodes, t.roots)


@add(
    "closure_sizes",
    with_parts(
        """, r AS (SELECT target AS root, source AS path FROM local UNION SELECT r.root, e.source FROM r JOIN local e ON e.target = r.path),
        c AS (SELECT root, count(*) AS n FROM r GROUP BY root)
        SELECT id AS path, coalesce(n, 0) AS dependents, coalesce(n, 0) < 4096 AS exact FROM nodes LEFT JOIN c ON root = id""",
        "local",
        "nodes",
    ),
)
def _(t):
    return TR.closure_sizes(t.local, t.nodes)


@add("degree_centrality", with_parts("SELECT * FROM degree", "degree"))
def _(t):
    return CE.degree_centrality(t.local, t.nodes)


@add("god_nodes", with_parts("SELECT * FROM degree ORDER BY total_degree DESC, path LIMIT 10", "degree"))
def _(t):
    return CE.god_nodes(t.local, t.nodes, 10)


@add(
    "most_connected",
    with_parts(
        """SELECT path, count(*) AS connections FROM (SELECT source AS path FROM cross_e UNION ALL SELECT target FROM cross_e)
        GROUP BY path ORDER BY connections DESC, path LIMIT 10""",
        "cross_e",
    ),
)
def _(t):
    return CE.most_connected(t.cross, 10)


@add(
    "centrality_rank",
    with_parts(
        """SELECT path, repo, label, total_degree, in_degree, out_degree, rating,
        row_number() OVER (PARTITION BY repo ORDER BY total_degree DESC, path) AS rank FROM degree""",
        "degree",
    ),
)
def _(t):
    d = CE.degree_centrality(t.local, t.nodes)
    return CE.centrality_rank(d, d).withColumn("rank", F.col("rank").cast("long"))


_PATHS = """, p AS (SELECT DISTINCT source AS s, source AS node, [source] AS path FROM {e} UNION ALL
  SELECT p.s, e.target, list_append(p.path, e.target) FROM p JOIN {e} e ON e.source = p.node WHERE NOT list_contains(p.path, e.target)),
k AS (SELECT s, node AS t, path, len(path) AS n, min(len(path)) OVER (PARTITION BY s, node) AS mn FROM p)"""


@add(
    "betweenness",
    with_parts(
        _PATHS.format(e="sparse")
        + """, sp AS (SELECT s, t, path, count(*) OVER (PARTITION BY s, t) AS sigma FROM k WHERE n = mn AND s <> t),
        c AS (SELECT v, 1.0 / sigma AS w FROM (SELECT unnest(path[2:len(path) - 1]) AS v, sigma FROM sp WHERE len(path) > 2)),
        z AS (SELECT repo, count(*) AS n FROM nodes GROUP BY repo), b AS (SELECT v, sum(w) AS w FROM c GROUP BY v)
        SELECT nodes.repo, id AS path, round(coalesce(w, 0), 6) AS betweenness,
          round(coalesce(w, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 9) AS normalized_betweenness
        FROM nodes JOIN z ON z.repo = nodes.repo LEFT JOIN b ON v = id""",
        "sparse",
        "nodes",
    ),
)
def _(t):
    b = CE.betweenness(t.sparse, t.nodes)
    return b.withColumn("betweenness", F.round("betweenness", 6)).withColumn("normalized_betweenness", F.round("normalized_betweenness", 9))


@add(
    "betweenness_sampled",
    with_parts(
        _PATHS.format(e="sparse")
        + """, z AS (SELECT repo, count(*) AS n FROM nodes GROUP BY repo),
        d AS (SELECT id, n, least(n, ceil(pow(n * 1.0 / greatest(n - 1, 1), 2) * ln(2 * n / 0.1) / (2 * 0.3 * 0.3))) AS m,
          row_number() OVER (PARTITION BY nodes.repo ORDER BY md5(id), id) AS place FROM nodes JOIN z ON z.repo = nodes.repo),
        sp AS (SELECT s, path, n / m AS scale, count(*) OVER (PARTITION BY s, t) AS sigma FROM (SELECT k.s, k.t, k.path, d.n, d.m FROM k JOIN d ON d.id = k.s AND place <= m WHERE k.n = mn AND s <> t)),
        b AS (SELECT v, sum(w) AS w FROM (SELECT unnest(path[2:len(path) - 1]) AS v, scale / sigma AS w FROM sp WHERE len(path) > 2) GROUP BY v)
        SELECT nodes.repo, id AS path, round(coalesce(w, 0), 6) AS betweenness,
          round(coalesce(w, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 9) AS normalized_betweenness
        FROM nodes JOIN z ON z.repo = nodes.repo LEFT JOIN b ON v = id""",
        "sparse",
        "nodes",
    ),
)
def _(t):
    b = CE.sampled_betweenness(t.sparse, t.nodes, epsilon=0.3, delta=0.1)
    return b.withColumn("betweenness", F.round("betweenness", 6)).withColumn("normalized_betweenness", F.round("normalized_betweenness", 9))


@add(
    "shortest_paths",
    with_parts(
        _PATHS.format(e="sparse")
        + """, sp AS (SELECT s, t, min(path) AS path FROM k WHERE n = mn GROUP BY s, t),
        q AS (SELECT id AS source, worst AS target FROM nodes JOIN worst USING (repo)),
        found AS (SELECT q.source, q.target, coalesce(f.path, CASE WHEN q.source = q.target THEN [q.source] END) AS fp, b.path AS bp
          FROM q LEFT JOIN sp f ON f.s = q.source AND f.t = q.target LEFT JOIN sp b ON b.s = q.target AND b.t = q.source),
        r AS (SELECT source, target, CASE WHEN fp IS NOT NULL THEN 'forward' WHEN bp IS NOT NULL THEN 'reverse' ELSE 'none' END AS direction, coalesce(fp, bp) AS path FROM found),
        w AS (SELECT source, target, count(*) FILTER (rating < 6) AS bottlenecks FROM (SELECT source, target, unnest(path) AS id FROM r) JOIN nodes USING (id) GROUP BY 1, 2)
        SELECT r.source, r.target, direction, coalesce(array_to_string(path, ' > '), '') AS path, CAST(coalesce(len(path) - 1, -1) AS INT) AS length, coalesce(bottlenecks, 0) AS bottlenecks
        FROM r LEFT JOIN w ON w.source = r.source AND w.target = r.target""",
        "sparse",
        "nodes",
        "worst",
    ),
)
def _(t):
    pairs = t.nodes.select("repo", F.col("id").alias("source")).join(t.worst, "repo").select("source", F.col("worst").alias("target"))
    out = TR.shortest_paths(t.sparse, t.nodes, pairs).withColumn("path", F.coalesce(F.array_join("path", " > "), F.lit("")))
    return out.fillna({"length": -1, "bottlenecks": 0})


@add(
    "adjacency",
    with_parts(
        """SELECT source AS path, count(*) OVER (PARTITION BY source) AS degree, target AS neighbour FROM local""", "local"
    ),
)
def _(t):
    return CE.adjacency(t.local).select("path", "degree", F.explode("neighbours").alias("neighbour"))


@add(
    "reverse_adjacency",
    with_parts(
        """SELECT target AS path, count(*) OVER (PARTITION BY target) AS degree, source AS neighbour FROM local""", "local"
    ),
)
def _(t):
    return CE.adjacency(t.local, reverse=True, chunk=5).select("path", "degree", F.explode("neighbours").alias("neighbour"))


@add("cycle_groups", with_parts("SELECT * FROM scc", "scc"))
def _(t):
    return t.components


@add("cycle_summary", with_parts("SELECT component, max(size) AS size FROM scc GROUP BY component", "scc"))
def _(t):
    return CO.cycle_summary(t.components)


@add("cycle_groups_dense", with_parts("SELECT * FROM scc_local", "scc_local"))
def _(t):
    return CO.strong_components(t.local)


@add(
    "cycle_edges",
    with_parts(
        "SELECT e.*, a.component FROM sparse e JOIN scc a ON a.path = e.source JOIN scc b ON b.path = e.target AND b.component = a.component", "scc"
    ),
)
def _(t):
    return CO.cycle_edges(t.sparse, t.components)


@add(
    "elementary_cycles",
    with_parts(
        """, p AS (SELECT source AS s, target AS node, [source] AS path FROM sparse WHERE target >= source UNION ALL
        SELECT p.s, e.target, list_append(p.path, p.node) FROM p JOIN sparse e ON e.source = p.node
        WHERE p.node > p.s AND e.target >= p.s AND NOT list_contains(p.path, p.node) AND len(p.path) < 6)
        SELECT array_to_string(path, ' > ') AS cycle, CAST(len(path) AS INT) AS length FROM p WHERE node = s AND len(path) <= 6""",
        "sparse",
    ),
)
def _(t):
    return CO.elementary_cycles(t.sparse, t.components, 6).withColumn("cycle", F.array_join("cycle", " > "))


@add(
    "cycle_penalty",
    with_parts(
        "SELECT id AS path, CAST(scc.path IS NOT NULL AS INT) AS n_cycles, greatest(0.0, rating - CAST(scc.path IS NOT NULL AS INT)) AS penalised FROM nodes LEFT JOIN scc ON scc.path = id",
        "scc",
        "nodes",
    ),
)
def _(t):
    c = t.components.select("path", F.lit(1).alias("n_cycles"))
    n = t.nodes.select(F.col("id").alias("path"), "rating").join(c, "path", "left").fillna(0, ["n_cycles"])
    return n.select("path", "n_cycles", R.cycle_penalty(F.col("rating"), F.col("n_cycles")).alias("penalised"))


@add(
    "fix_order",
    with_parts(
        """, p AS (SELECT id, 0 AS level FROM nodes UNION SELECT e.source, level + 1 FROM p JOIN acyclic e ON e.target = p.id)
        SELECT n.repo, n.id AS path, n.rating, max(level) AS level FROM p JOIN nodes n USING (id) GROUP BY 1, 2, 3""",
        "acyclic",
        "nodes",
    ),
)
def _(t):
    return OR.fix_order(t.acyclic, t.nodes)


@add(
    "fix_order_cyclic",
    with_parts(
        """, rated_n AS (SELECT repo, id, coalesce(rating, 10.0) AS rating FROM nodes),
        inner_e AS (SELECT DISTINCT a.repo, e.source, e.target FROM sparse e JOIN rated_n a ON a.id = e.source JOIN rated_n b ON b.id = e.target AND b.repo = a.repo WHERE e.source <> e.target),
        per AS (SELECT repo, count(*) AS total FROM rated_n GROUP BY repo),
        p AS (
            SELECT repo, -1 AS level, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS fresh FROM per
            UNION ALL
            SELECT s.repo, s.level + 1, list_concat(s.done, s.pick), s.pick
            FROM (
                SELECT o.repo, o.level, any_value(o.done) AS done,
                    CASE WHEN count(*) FILTER (o.blocked = 0) > 0 THEN list(o.id) FILTER (o.blocked = 0) ELSE [arg_min(o.id, (o.rating, o.id))] END AS pick
                FROM (
                    SELECT p.repo, p.level, n.id, n.rating, any_value(p.done) AS done,
                        count(e.target) FILTER (NOT list_contains(p.done, e.target)) AS blocked
                    FROM p JOIN rated_n n ON n.repo = p.repo LEFT JOIN inner_e e ON e.source = n.id
                    WHERE NOT list_contains(p.done, n.id)
                    GROUP BY p.repo, p.level, n.id, n.rating
                ) o GROUP BY o.repo, o.level
            ) s
        )
        SELECT p.repo, f.id AS path, n.rating, p.level FROM p, unnest(p.fresh) AS f(id) JOIN rated_n n ON n.id = f.id""",
        "sparse",
        "nodes",
    ),
)
def _(t):
    return OR.fix_order(t.sparse, t.nodes)


@add(
    "layers",
    with_parts(
        """, m AS (SELECT id AS path, coalesce(component, id) AS unit FROM nodes LEFT JOIN scc ON scc.path = id),
        ue AS (SELECT DISTINCT a.unit AS source, b.unit AS target FROM sparse e JOIN m a ON a.path = e.source JOIN m b ON b.path = e.target WHERE a.unit <> b.unit),
        p AS (SELECT DISTINCT unit, 0 AS level FROM m UNION SELECT e.source, level + 1 FROM p JOIN ue e ON e.target = p.unit),
        l AS (SELECT unit, max(level) AS layer FROM p GROUP BY unit)
        SELECT m.path, l.layer FROM m JOIN l USING (unit)""",
        "scc",
        "nodes",
    ),
)
def _(t):
    return OR.layers(t.sparse, t.nodes)


#: Steps of the worst at-risk dependents of the worst file of each repository; {worst} closes the ranking.
_PLAN = """, r AS (SELECT target AS root, source AS path FROM local JOIN worst ON worst = target UNION SELECT r.root, e.source FROM r JOIN local e ON e.target = r.path),
    pick AS (SELECT root, path, rating FROM (SELECT r.root, r.path, n.rating, row_number() OVER (PARTITION BY r.root ORDER BY n.rating, r.path) AS rn
        FROM r JOIN nodes n ON n.id = r.path WHERE n.rating < 6){worst}),
    sub_e AS (SELECT DISTINCT s.root, e.source, e.target FROM local e JOIN pick s ON s.path = e.source JOIN pick t ON t.path = e.target AND t.root = s.root WHERE e.source <> e.target),
    per AS (SELECT DISTINCT root FROM pick),
    p AS (
        SELECT root, -1 AS level, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS fresh FROM per
        UNION ALL
        SELECT s.root, s.level + 1, list_concat(s.done, s.pick), s.pick
        FROM (
            SELECT o.root, o.level, any_value(o.done) AS done,
                CASE WHEN count(*) FILTER (o.blocked = 0) > 0 THEN list(o.path) FILTER (o.blocked = 0) ELSE [arg_min(o.path, (o.rating, o.path))] END AS pick
            FROM (
                SELECT p.root, p.level, n.path, n.rating, any_value(p.done) AS done,
                    count(e.target) FILTER (NOT list_contains(p.done, e.target)) AS blocked
                FROM p JOIN pick n ON n.root = p.root LEFT JOIN sub_e e ON e.root = n.root AND e.source = n.path
                WHERE NOT list_contains(p.done, n.path)
                GROUP BY p.root, p.level, n.path, n.rating
            ) o GROUP BY o.root, o.level
        ) s
    ),
    placed AS (SELECT p.root, f.path, row_number() OVER (PARTITION BY p.root ORDER BY p.level, n.rating, f.path) - 1 AS step
        FROM p, unnest(p.fresh) AS f(path) JOIN pick n ON n.root = p.root AND n.path = f.path),
    scored AS (SELECT path, type, line, CASE severity WHEN 'error' THEN 1.5 WHEN 'warning' THEN 0.5 ELSE 0.1 END AS points FROM fviol),
    top AS (SELECT path, arg_min(struct_pack(type := type, points := points), (CASE WHEN type IN ('any_type', 'console_log') THEN -points ELSE -points / 3 END, type, line)) AS v FROM scored GROUP BY path),
    steps AS (SELECT root, CAST(step AS INT) AS step, path, v.type AS rule, CASE v.type WHEN 'any_type' THEN 'replace' ELSE 'manual' END AS action,
            CASE v.type WHEN 'any_type' THEN 'unknown' END AS replacement, CAST(v.points AS DOUBLE) AS gain
        FROM placed JOIN top USING (path))
    SELECT *, floor(sum(gain) OVER (PARTITION BY root) * 10 + 0.5) / 10 AS total_gain FROM steps"""


@add("remediation_plan", with_parts(_PLAN.format(worst=" WHERE rn <= 10"), "local", "nodes", "worst", "fviol"))
def _(t):
    return OR.remediation_plan(t.local, t.nodes, t.violations, t.worst.select(F.col("worst").alias("root")))


@add("remediation_plan_all", with_parts(_PLAN.format(worst=""), "local", "nodes", "worst", "fviol"))
def _(t):
    return OR.remediation_plan(t.local, t.nodes, t.violations, t.worst.select(F.col("worst").alias("root")), worst=None)


@add(
    "cross_module_edges",
    with_parts(
        "SELECT repo, source, target, source_module, target_module, pair_count, distance, round(score, 9) AS score, explanation FROM cross_mod", "cross_mod"
    ),
)
def _(t):
    return CU.cross_module_edges(t.cross, t.nodes).withColumn("score", F.round("score", 9))


@add(
    "surprising_edges",
    with_parts(
        """SELECT repo, source, target, round(score, 9) AS score, explanation, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, source, target) AS rank FROM cross_mod)
        WHERE rank <= 10""",
        "cross_mod",
    ),
)
def _(t):
    out = CU.surprising(t.cross, t.nodes, 10)
    return out.select("repo", "source", "target", F.round("score", 9).alias("score"), "explanation", F.col("rank").cast("long").alias("rank"))


@add(
    "surprising_edges_inverse",
    with_parts(
        """SELECT repo, source, target, round(1 / ln(pair_count + 1), 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pair_count, source, target) AS rank FROM cross_mod)
        WHERE rank <= 5""",
        "cross_mod",
    ),
)
def _(t):
    from ..functions.paths import MODULE_PREFIXES_NARROW

    out = CU.surprising(t.cross, t.nodes, 5, MODULE_PREFIXES_NARROW, "inverse")
    return out.select("repo", "source", "target", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@add(
    "suggested_questions",
    with_parts(_QUESTIONS + " SELECT repo, ord, type, tool, file, question FROM asked", "degree", "worst"),
)
def _(t):
    return CU.suggested_questions(t.local, t.nodes).withColumn("ord", F.col("ord").cast("long"))


@add(
    "prompt_questions",
    with_parts(
        f""", g AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY total_degree DESC, path) AS rn FROM degree)
        SELECT repo, rn AS ord, 'What would break if "' || substr(path, length(repo) + 2) || '" changed?' AS question FROM g WHERE rn <= 3
        UNION ALL SELECT g.repo, 4, 'How does "' || substr(path, length(g.repo) + 2) || '" connect to "' || substr(worst, length(g.repo) + 2) || '" (worst-rated file)?'
          FROM g JOIN worst USING (repo) WHERE rn = 1 AND path <> worst
        UNION ALL SELECT repo, 5, 'What''s wrong with "' || substr(worst, length(repo) + 2) || '" (rating ' || {js('rating')} || '/10)?' FROM worst WHERE rating < 7""",
        "degree",
        "worst",
    ),
)
def _(t):
    return CU.prompt_questions(t.local, t.nodes).withColumn("ord", F.col("ord").cast("long"))


@add(
    "risk_scores",
    with_parts(
        """SELECT root, affected, fragile AS fragile_count, CASE WHEN fragile > 0 THEN CAST(least(10, floor(fragile * 2 + gap / 10 / fragile + 0.5)) AS BIGINT) ELSE 0 END AS risk_score FROM risk2""",
        "risk2",
    ),
)
def _(t):
    return RK.risk_scores(t.local, t.nodes, t.roots)


@add(
    "impact_verdicts",
    with_parts(
        """SELECT root, file_rating, affected, direct AS direct_dependents, fragile AS fragile_count,
        CASE WHEN fragile >= 3 THEN 10 WHEN fragile >= 1 THEN 5 ELSE 0 END AS risk_score,
        CASE WHEN fragile >= 3 THEN 'block' WHEN fragile >= 1 THEN 'warn' ELSE 'safe' END AS verdict,
        CASE WHEN fragile >= 3 THEN fragile || ' fragile dependents — high risk of cascading failures'
          WHEN fragile >= 1 THEN fragile || ' fragile dependent(s) — verify after change' ELSE 'Low blast radius' END AS reason FROM risk2""",
        "risk2",
    ),
)
def _(t):
    return RK.impact_verdicts(t.local, t.nodes, t.roots)


@add(
    "edit_safety",
    with_parts(
        f""", v AS (SELECT *, CASE WHEN fragile = 0 AND affected < 5 THEN 'safe' WHEN direct_fragile >= 3 OR fragile >= 5 THEN 'block' ELSE 'warn' END AS verdict FROM risk3),
        top AS (SELECT root, string_agg({base('path')}, ', ' ORDER BY rn) AS names FROM (
          SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, rating, path) AS rn FROM impact3 WHERE rating < 6 QUALIFY rn <= 3) GROUP BY root)
        SELECT v.root, file_rating, affected, fragile AS fragile_count, direct_fragile, verdict,
        CASE verdict WHEN 'safe' THEN 'Low blast radius (' || affected || ' affected files, none fragile).'
          WHEN 'block' THEN fragile || ' fragile dependents (' || direct_fragile || ' direct). High risk of cascading failures.'
          ELSE fragile || ' fragile dependent(s) — verify after change.' END AS reason,
        CASE WHEN verdict = 'safe' THEN '' ELSE concat_ws(' | ',
          CASE WHEN file_rating >= 7 THEN 'Source file is healthy — changes are lower risk if interface is preserved.' END,
          CASE WHEN fragile > 0 THEN 'Fix fragile dependents first: ' || names END,
          'Use `get_impact_set` with depth=1 to see direct dependents only.', 'Use `summarize_file` on each fragile dependent to understand coupling.') END AS suggestions
        FROM v LEFT JOIN top USING (root)""",
        "risk3",
    ),
)
def _(t):
    return RK.edit_safety(t.local, t.nodes, t.roots).withColumn("suggestions", F.array_join("suggestions", " | "))


@add(
    "explain_nodes",
    with_parts(
        """, top AS (SELECT source, target FROM (SELECT m.*, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, source, target) AS rank FROM local_mod m) WHERE rank <= 10),
        odd AS (SELECT path, count(*) AS c FROM (SELECT source AS path FROM top UNION ALL SELECT target FROM top WHERE source <> target) GROUP BY path)
        SELECT d.path, d.rating, row_number() OVER (PARTITION BY d.repo ORDER BY d.total_degree DESC, d.path) AS rank, in_degree, out_degree, total_degree,
          r.affected AS impacted, r.fragile, coalesce(o.c, 0) AS surprising,
          CASE WHEN in_degree > 5 THEN 'god node' WHEN out_degree > 10 THEN 'highly coupled' ELSE 'standard' END AS role
        FROM degree d JOIN risk2 r ON r.root = d.path LEFT JOIN odd o ON o.path = d.path""",
        "degree",
        "risk2",
        "local_mod",
    ),
)
def _(t):
    return CU.explain_nodes(t.local, t.nodes, t.nodes.select(F.col("id").alias("path")))


@add(
    "graph_report",
    with_parts(
        _QUESTIONS
        + """, m AS (SELECT repo, module, count(*) AS files, floor(avg(rating) * 10 + 0.5) / 10 AS r, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, module) AS rn FROM nodes GROUP BY 1, 2),
        h AS (SELECT n.repo, count(*) AS files, floor(avg(rating) * 10 + 0.5) / 10 AS overall FROM nodes n GROUP BY 1),
        rel AS (SELECT n.repo, count(*) AS c FROM local e JOIN nodes n ON n.id = e.source GROUP BY 1),
        cyc AS (SELECT n.repo, count(DISTINCT component) AS c FROM scc JOIN nodes n ON n.id = scc.path GROUP BY 1),
        odd AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, source, target) AS rn FROM local_mod)
        SELECT repo, 'header' AS section, 1 AS ord, 'files' AS item, CAST(files AS VARCHAR) AS value FROM h
        UNION ALL SELECT h.repo, 'header', 2, 'relationships', CAST(coalesce(c, 0) AS VARCHAR) FROM h LEFT JOIN rel ON rel.repo = h.repo
        UNION ALL SELECT repo, 'header', 3, 'overall_rating', printf('%.1f', overall) FROM h
        UNION ALL SELECT h.repo, 'header', 4, 'cycles', CAST(coalesce(c, 0) AS VARCHAR) FROM h LEFT JOIN cyc ON cyc.repo = h.repo
        UNION ALL SELECT g.repo, 'god_nodes', CAST(rn AS INT), g.path, CAST(d.total_degree AS VARCHAR) FROM g JOIN degree d ON d.path = g.path WHERE rn <= 5
        UNION ALL SELECT repo, 'surprising', CAST(rn AS INT), source || ' -> ' || target, explanation FROM odd WHERE rn <= 5
        UNION ALL SELECT repo, 'questions', CAST(ord AS INT), question, tool FROM asked
        UNION ALL SELECT repo, 'modules', CAST(rn AS INT), module, files || ' files, ' || printf('%.1f', r) FROM m WHERE rn <= 8""",
        "degree",
        "worst",
        "scc",
        "local_mod",
    ),
)
def _(t):
    return RP.graph_report(t.local, t.nodes, t.components)


@add(
    "neighbourhood",
    with_parts(
        "SELECT w.worst AS file, e.source, e.target, e.type, e.strength FROM worst w JOIN local e ON e.source = w.worst OR e.target = w.worst", "worst", "local"
    ),
)
def _(t):
    return CE.neighbourhood(t.local, t.worst.select(F.col("worst").alias("path")))


@add("graph_payload", with_parts("SELECT id, label, rating, loc, complexity, imports, errors, warnings FROM nodes", "nodes"))
def _(t):
    return RP.graph_payload(t.nodes)
