"""SQL text shared by the checks of the query catalogue: the adapters, written for DuckDB."""

from __future__ import annotations

_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _edges(keys: str) -> str:
    part = f"l_orderkey{', ' + keys if keys else ''}"
    return f"""SELECT repo, source, target, type, weight, o1, o2, o3, o4, o5, l_linestatus FROM (
      SELECT f.repo, f.path AS source, lead(f.path) OVER (PARTITION BY {part} ORDER BY {_LINE}) AS target,
        CASE l_linestatus WHEN 'O' THEN 'import' ELSE 'usage' END AS type, CAST(l_linenumber AS DOUBLE) AS weight,
        l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3, l_quantity AS o4, l_extendedprice AS o5, l_linestatus
      FROM lineitem JOIN files f ON l_partkey = f.part) WHERE target IS NOT NULL AND target <> source"""


def _first(raw: str) -> str:
    return f"""SELECT source, target, type, weight AS strength FROM {raw}
      QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY o1, o2, o3, o4, o5) = 1"""


def js(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def r1(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


PARTS = {
    "files": (
        [],
        """SELECT p_partkey AS part, '/work/' || lower(replace(p_brand, '#', '_')) AS repo,
      '/work/' || lower(replace(p_brand, '#', '_')) || '/src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '/part_' || p_partkey
        || CASE p_size % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' ELSE '.jsx' END AS path,
      CASE p_size % 4 WHEN 0 THEN 'csharp' WHEN 1 THEN 'typescript' WHEN 2 THEN 'tsx' ELSE 'jsx' END AS language,
      lower(p_type) AS module, replace(p_name, ' ', '_') AS name,
      CAST(p_size * 11 AS INT) AS loc, CAST(p_size % 25 AS INT) AS cc, CAST(p_partkey % 45 AS INT) AS methods,
      CAST(p_size % 3 AS INT) AS classes, CAST(p_size % 35 AS INT) AS imports,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 101 AS DOUBLE) END AS coverage FROM part""",
    ),
    "viol": (
        [],
        """SELECT part, CASE kind WHEN 'RF' THEN 'any_type' WHEN 'RO' THEN 'console_log' WHEN 'AF' THEN 'missing_key'
        WHEN 'AO' THEN 'long_method' WHEN 'NF' THEN 'empty_catch' ELSE 'custom_rule' END AS type,
      CASE WHEN q >= 34 THEN 'error' WHEN q >= 29 THEN 'warning' ELSE 'info' END AS severity, CAST(line AS INT) AS line
      FROM (SELECT l_partkey AS part, l_returnflag || l_linestatus AS kind, avg(l_quantity) AS q, min(l_suppkey) AS line
            FROM lineitem GROUP BY ALL)""",
    ),
    "fviol": (
        ["files", "viol"],
        "SELECT f.repo, f.path, v.type, v.severity, v.line, v.type || ' found at line ' || v.line AS message, 'Resolve ' || v.type AS fix FROM viol v JOIN files f USING (part)",
    ),
    "counted": (
        ["files", "viol"],
        """SELECT f.*, CAST(coalesce(errors, 0) AS INT) AS errors, CAST(coalesce(warnings, 0) AS INT) AS warnings,
      CAST(coalesce(infos, 0) AS INT) AS infos, CAST(coalesce(nv, 0) AS INT) AS n_violations
      FROM files f LEFT JOIN (SELECT part, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'info') AS infos, count(*) AS nv FROM viol GROUP BY part) USING (part)""",
    ),
    "rated": (
        ["counted"],
        """SELECT *, greatest(0, least(100, 100 - 15 * errors - 5 * warnings - infos
        - CASE WHEN coverage < 30 THEN 25 WHEN coverage < 50 THEN 20 WHEN coverage < 80 THEN 10 ELSE 0 END
        - CASE WHEN methods > 40 THEN 15 WHEN methods > 20 THEN 5 ELSE 0 END
        - CASE WHEN methods > 0 AND floor(loc / methods + 0.5) > 40 THEN 10 ELSE 0 END
        - CASE WHEN cc > 20 THEN 20 WHEN cc > 10 THEN 10 ELSE 0 END
        - CASE WHEN imports > 30 THEN 20 WHEN imports > 15 THEN 5 ELSE 0 END
        - CASE WHEN loc > 500 THEN 15 WHEN loc > 300 THEN 5 ELSE 0 END)) / 10 AS rating FROM counted""",
    ),
    "nodes": (
        ["rated"],
        f"""SELECT repo, path AS id, {base('path')} AS label, language, rating, greatest(1.0, loc / 100) AS size, loc, cc AS complexity,
      imports, n_violations, errors, warnings, module FROM rated""",
    ),
    "raw_local": (["files"], _edges("f.repo")),
    "raw_sparse": (["files"], _edges("f.repo, l_returnflag")),
    "raw_cross": (["files"], _edges("")),
    "local": (["raw_local"], _first("raw_local")),
    "sparse": (["raw_sparse"], _first("raw_sparse")),
    "cross_e": (["raw_cross"], _first("raw_cross")),
    "acyclic": (["sparse"], "SELECT DISTINCT greatest(source, target) AS source, least(source, target) AS target FROM sparse"),
    "raw_f": (["raw_sparse"], "SELECT * FROM raw_sparse WHERE l_linestatus = 'F'"),
    "raw_o": (["raw_sparse"], "SELECT * FROM raw_sparse WHERE l_linestatus = 'O'"),
    "edges_f": (["raw_f"], _first("raw_f")),
    "edges_o": (["raw_o"], _first("raw_o")),
    **{
        f"nodes_{s.lower()}": (
            [f"edges_{s.lower()}", "files"],
            f"""SELECT f.path AS id, {base('f.path')} AS label, r.rating FROM (SELECT source AS id FROM edges_{s.lower()} UNION SELECT target FROM edges_{s.lower()}) e
      JOIN files f ON f.path = e.id JOIN (SELECT l_partkey AS part, {r1('avg(l_quantity) / 5')} AS rating FROM lineitem WHERE l_linestatus = '{s}' GROUP BY 1) r USING (part)""",
        )
        for s in ("F", "O")
    },
    "history": (
        [],
        """SELECT '/repo_' || (user_id % 4) AS repo, '/file_' || user_id AS path,
      floor(least(value, 50.0) / 5.0 * 10 + 0.5) / 10 AS rating, ts AS recorded_at, event_id AS seq, event_type FROM events""",
    ),
    "changes": (
        [],
        """SELECT '/repo_' || (user_id % 4) AS repo, '/file_' || user_id AS path, ts AS mtime,
      CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, ts, event_id AS seq FROM events""",
    ),
    "corpus": (
        [],
        "SELECT '/repo/' || source || '/doc_' || doc_id || '.ts' AS path, source AS module, lang AS language, text AS content FROM documents",
    ),
    "lines": (
        ["corpus"],
        "SELECT path, language, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS text FROM (SELECT path, language, string_split(content, chr(10)) AS t FROM corpus)",
    ),
    "code_lines": (
        ["lines"],
        """SELECT path, line, CASE language WHEN 'en' THEN '// TODO ' WHEN 'fr' THEN '/* hack ' WHEN 'de' THEN 'throw new Error(''todo ' ELSE '' END || text AS text FROM lines""",
    ),
    "why_lines": (
        ["lines"],
        "SELECT path, line, CASE language WHEN 'en' THEN '// why: ' WHEN 'fr' THEN '//because: ' ELSE '' END || text AS text FROM lines",
    ),
    "calls": (["lines"], "SELECT path, line, replace(text, ' ', '( ') AS text FROM lines"),
    "cov": (
        ["files"],
        """SELECT path, CAST(l_suppkey AS INT) AS line, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS hits
      FROM lineitem JOIN files ON part = l_partkey GROUP BY 1, 2""",
    ),
    "rollup_cov": (
        ["cov"],
        """SELECT path, count(*) AS found, count(*) FILTER (hits > 0) AS hit,
      floor(count(*) FILTER (hits > 0) / count(*) * 1000 + 0.5) / 10 AS percent FROM cov GROUP BY path""",
    ),
    "qlog": (
        [],
        """SELECT user_id AS session_id, event_type AS tool, CAST(floor(value) AS BIGINT) % 40 AS files_not_read,
      length(props) * 25 AS response_chars, ts FROM events""",
    ),
    "queue": (
        [],
        """SELECT o_orderkey AS id, '/repo_' || (o_custkey % 4) AS repo,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'in_progress' WHEN '3' THEN 'completed' WHEN '4' THEN 'failed' ELSE 'skipped' END AS status,
      o_totalprice AS priority_score, o_orderdate AS created_at, o_orderstatus AS state FROM orders""",
    ),
    "worst": (
        ["nodes"],
        "SELECT repo, arg_min(id, (rating, id)) AS worst, min(rating) AS rating FROM nodes GROUP BY repo",
    ),
    "degree": (
        ["local", "nodes"],
        """SELECT n.repo, n.id AS path, n.label, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree,
      coalesce(i.c, 0) + coalesce(o.c, 0) AS total_degree, n.rating FROM nodes n
      LEFT JOIN (SELECT target AS id, count(*) AS c FROM local GROUP BY 1) i USING (id)
      LEFT JOIN (SELECT source AS id, count(*) AS c FROM local GROUP BY 1) o USING (id)""",
    ),
    **{
        f"impact{d}": (
            ["local", "nodes"],
            f"""SELECT w.root, w.node AS path, w.depth, coalesce(n.rating, 10) AS rating FROM
      (SELECT root, node, min(depth) AS depth FROM walk{d} WHERE node <> root GROUP BY root, node) w LEFT JOIN nodes n ON n.id = w.node""",
        )
        for d in (2, 3)
    },
    "closure_sparse": (
        ["sparse"],
        "SELECT source AS a, target AS b FROM sparse UNION SELECT r.a, e.target FROM closure_sparse r JOIN sparse e ON e.source = r.b",
    ),
    "closure_local": (
        ["local"],
        "SELECT source AS a, target AS b FROM local UNION SELECT r.a, e.target FROM closure_local r JOIN local e ON e.source = r.b",
    ),
    "scc_local": (
        ["closure_local"],
        """SELECT x.a AS path, min(least(x.a, x.b)) AS component, count(DISTINCT x.b) AS size
      FROM closure_local x JOIN closure_local y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    ),
    "scc": (
        ["closure_sparse"],
        """SELECT x.a AS path, min(least(x.a, x.b)) AS component, count(DISTINCT x.b) AS size
      FROM closure_sparse x JOIN closure_sparse y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    ),
}

for _d in (2, 3):
    PARTS[f"walk{_d}"] = (
        ["local"],
        f"""SELECT DISTINCT target AS root, target AS node, 0 AS depth FROM local
      UNION SELECT w.root, e.source, w.depth + 1 FROM walk{_d} w JOIN local e ON e.target = w.node WHERE w.depth < {_d}""",
    )
    PARTS[f"impact{_d}"] = (["local", "nodes", f"walk{_d}"], PARTS[f"impact{_d}"][1])
    PARTS[f"risk{_d}"] = (
        [f"impact{_d}", "nodes"],
        f"""SELECT n.id AS root, n.rating AS file_rating, count(i.path) AS affected, count(i.path) FILTER (i.depth = 1) AS direct,
      count(i.path) FILTER (i.rating < 6) AS fragile, count(i.path) FILTER (i.rating < 6 AND i.depth = 1) AS direct_fragile,
      sum(CASE WHEN i.rating < 6 THEN 60 - round(i.rating * 10) ELSE 0 END) AS gap
      FROM nodes n LEFT JOIN impact{_d} i ON i.root = n.id GROUP BY 1, 2""",
    )

for _name, _table in (("cross_mod", "cross_e"), ("local_mod", "local")):
    PARTS[_name] = (
        [_table, "nodes"],
        f"""SELECT e.*, distance / ln(pair_count + 1) AS score,
      source_module || ' → ' || target_module || ' (' || pair_count || ' cross-edge' || CASE WHEN pair_count <> 1 THEN 's' ELSE '' END
        || ', distance ' || distance || ')' AS explanation FROM (
      SELECT s.repo, e.source, e.target, s.module AS source_module, t.module AS target_module,
        count(*) OVER (PARTITION BY s.repo, s.module, t.module) AS pair_count,
        CASE WHEN s.repo <> t.repo THEN 8 ELSE 4 END AS distance
      FROM {_table} e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE s.module <> t.module) e""",
    )


QUESTIONS = """, g AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY total_degree DESC, path) AS rn FROM degree),
  imp AS (SELECT repo, path FROM degree QUALIFY row_number() OVER (PARTITION BY repo ORDER BY in_degree DESC, total_degree DESC, path) = 1),
  mods AS (SELECT repo, count(DISTINCT module) AS m FROM nodes GROUP BY repo),
  q AS (SELECT repo, rn AS o, 'impact' AS type, 'get_impact_set' AS tool, path AS file, 'What would break if ' || substr(path, length(repo) + 2) || ' changed?' AS question FROM g WHERE rn <= 2
   UNION ALL SELECT repo, 3, 'dependency', 'get_impact_set', path, 'What depends on ' || substr(path, length(repo) + 2) || '?' FROM imp
   UNION ALL SELECT g.repo, 4, 'path', 'trace_path', path, 'How does ' || substr(path, length(g.repo) + 2) || ' connect to ' || substr(worst, length(g.repo) + 2) || ' (lowest-rated file)?'
     FROM g JOIN worst USING (repo) WHERE rn = 1 AND path <> worst
   UNION ALL SELECT repo, 5, 'health', 'suggest_refactoring', worst, 'How unhealthy is ' || substr(worst, length(repo) + 2) || ' and what should be fixed first?' FROM worst WHERE rating < 7
   UNION ALL SELECT g.repo, 6, 'explanation', 'explain_node', path, 'Which modules does ' || substr(path, length(g.repo) + 2) || ' bridge, and is that coupling intentional?'
     FROM g JOIN mods USING (repo) WHERE rn = 1 AND m > 2),
  asked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY o) AS ord FROM q QUALIFY ord <= 5)"""


def with_parts(body: str, *names: str) -> str:
    """Prefix ``body`` with the named fragments and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    joint = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH RECURSIVE {ctes}{joint}{body.lstrip()}"
