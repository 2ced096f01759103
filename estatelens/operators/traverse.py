"""Reachability over the dependency graph, always for a whole table of roots at once.

Edges say "source depends on target"; the dependents of a file are found by walking edges from
target to source. Loops run on numbered nodes (order-preserving longs), and every round is a
written table (see ``session.materialize``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Written, materialize

UNKNOWN_RATING = 10.0
FRAGILE = 6.0
HOT_SHARE = 64  # a node counts as hot when it holds more than 1/64 of all edges
SALTS = 32
SLICE = 1024  # files of a component that are paired with a root in one task
WIDE = 256  # dependencies of a file that are looked through for each pair; more are joined
FEW = 4  # roots are few if less than 1/4 of all files
HUB_ROUNDS = 32


@dataclass
class NumberedGraph:
    """Nodes and edges with long keys.

    ``nodes``: (nid, id). ``links``: (src, dst, src_salt, dst_salt). ``hot_src`` / ``hot_dst``:
    nodes whose out- or in-edges are spread over SALTS keys; at most HOT_SHARE rows each.
    """

    nodes: Written
    links: Written
    hot_src: DataFrame | None
    hot_dst: DataFrame | None

    def encode(self, df: DataFrame, column: str, to: str) -> DataFrame:
        n = self.nodes.df.select(F.col("id").alias(column), F.col("nid").alias(to))
        return df.join(n, column).drop(column)

    def decode(self, df: DataFrame, column: str, to: str) -> DataFrame:
        n = self.nodes.df.select(F.col("nid").alias(column), F.col("id").alias(to))
        return df.join(n, column).drop(column)

    def dependents(self, frontier: DataFrame, key: str, out: str) -> DataFrame:
        """Join each frontier row with the files that depend on ``key``."""
        return self._step(frontier, key, out, "dst", "src", "dst_salt", self.hot_dst)

    def dependencies(self, frontier: DataFrame, key: str, out: str) -> DataFrame:
        """Join each frontier row with the files ``key`` depends on."""
        return self._step(frontier, key, out, "src", "dst", "src_salt", self.hot_src)

    def _step(self, frontier, key, out, at, other, salt, hot) -> DataFrame:
        links = self.links.df
        if hot is None:
            return frontier.join(links.select(F.col(at).alias(key), F.col(other).alias(out)), key)
        salted = frontier.join(F.broadcast(hot.select(F.col("node").alias(key), F.lit(True).alias("_hot"))), key, "left")
        salted = salted.withColumn(
            "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        ).drop("_hot")
        e = links.select(F.col(at).alias(key), F.col(other).alias(out), F.col(salt).alias("_salt"))
        return salted.join(e, [key, "_salt"]).drop("_salt")

    def drop(self) -> None:
        self.nodes.drop()
        self.links.drop()


def _hot(links: DataFrame, column: str, total: int) -> DataFrame | None:
    """Nodes with more than 1/HOT_SHARE of all edges. There can be at most HOT_SHARE of them."""
    rows = (
        links.groupBy(F.col(column).alias("node"))
        .count()
        .filter(F.col("count") > total / HOT_SHARE)
        .select("node")
        .collect()
    )
    if not rows:
        return None
    return links.sparkSession.createDataFrame([(r[0],) for r in rows], "node long")


def number_graph(edges: DataFrame, extra_ids: DataFrame | None = None, keep_parallel: bool = False) -> NumberedGraph:
    """Give every node a long key that sorts like its id, and rewrite the edges to these keys."""
    ids = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
    if extra_ids is not None:
        ids = ids.union(extra_ids.select("id"))
    nodes = materialize(
        ids.distinct()
        .repartitionByRange("id")
        .sortWithinPartitions("id")
        .select(F.monotonically_increasing_id().alias("nid"), "id"),
        "nodes",
    )
    n = nodes.df
    links = (
        edges.select("source", "target")
        .join(n.select(F.col("id").alias("source"), F.col("nid").alias("src")), "source")
        .join(n.select(F.col("id").alias("target"), F.col("nid").alias("dst")), "target")
        .select("src", "dst")
    )
    if not keep_parallel:
        links = links.distinct()
    return salted_graph(nodes, links)


def salted_graph(nodes: Written, links: DataFrame) -> NumberedGraph:
    """Write links (src, dst) of numbered nodes, those of hot nodes spread over SALTS keys."""
    plain = materialize(links, "links")
    hot_src, hot_dst = _hot(plain.df, "src", plain.rows), _hot(plain.df, "dst", plain.rows)
    if hot_src is None and hot_dst is None:
        zero = F.lit(0)
        out = Written(plain.df.withColumn("src_salt", zero).withColumn("dst_salt", zero), plain.path, plain.rows)
        return NumberedGraph(nodes, out, None, None)

    def salt(df, column, other, hot):
        if hot is None:
            return df.withColumn(f"{column}_salt", F.lit(0))
        marked = df.join(F.broadcast(hot.select(F.col("node").alias(column), F.lit(True).alias("_h"))), column, "left")
        value = F.when(F.col("_h"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        return marked.withColumn(f"{column}_salt", value).drop("_h")

    salted = materialize(salt(salt(plain.df, "src", "dst", hot_src), "dst", "src", hot_dst), "links")
    plain.drop()
    return NumberedGraph(nodes, salted, hot_src, hot_dst)


class _Dependents:
    """Edges from a file to its dependents; those of a file with more than 1/``hot_share`` of all edges are spread over
    SALTS keys. There are fewer than ``hot_share`` such files, and without any the edges stay as they are.
    """

    def __init__(self, edges: DataFrame, hot_share: int):
        total = Observation()
        counts = edges.groupBy("target").count().observe(total, F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        most = counts.orderBy(F.desc("count"), "target").limit(hot_share).collect()
        hot = [(r["target"],) for r in most if r["count"] * hot_share > total.get["n"]]
        self.back = edges.select(F.col("target").alias("at"), F.col("source").alias("path"))
        self.hot = edges.sparkSession.createDataFrame(hot, "at string").withColumn("_hot", F.lit(True)) if hot else None
        if hot:
            salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).otherwise(0)
            self.back = self.back.join(F.broadcast(self.hot), "at", "left").select("at", "path", salt.alias("_salt"))

    def step(self, level: DataFrame) -> DataFrame:
        """(root, path) of the dependents of each row (root, at); rows may repeat."""
        if self.hot is None:
            return level.join(self.back, "at").select("root", "path")
        salts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        level = level.join(F.broadcast(self.hot), "at", "left").select("root", "at", salts.alias("_salt"))
        return level.join(self.back, ["at", "_salt"]).select("root", "path")


def _walk(edges: DataFrame, roots: DataFrame, depth: int, hot_share: int) -> DataFrame:
    """Levels of a walk of known depth: (root, path, depth), each pair at its least depth.

    Two levels are one lazy plan. A deeper walk writes its levels, and a level expands only pairs not seen before, so
    the plan of each round holds one join with the edges and one with the levels so far.
    """
    dependents = _Dependents(edges, hot_share)
    level = roots.select(F.col("root"), F.col("root").alias("at"))
    if depth <= 2:
        out = first = dependents.step(level).where("path <> root").distinct().withColumn("depth", F.lit(1))
        if depth == 2:
            out = first.unionByName(dependents.step(first.select("root", F.col("path").alias("at"))).withColumn("depth", F.lit(2)))
            out = out.where("path <> root").groupBy("root", "path").agg(F.min("depth").alias("depth"))
        return out
    seen: list[Written] = []
    for d in range(1, depth + 1):
        new = dependents.step(level).where("path <> root").distinct()
        for old in _together(seen):
            new = new.join(old.select("root", "path"), ["root", "path"], "left_anti")
        done = materialize(new.withColumn("depth", F.lit(d)), "walk")
        seen.append(done)
        if not done.rows:
            break
        level = done.df.select("root", F.col("path").alias("at"))
    return _together(seen)[0]


def reach(
    graph: NumberedGraph,
    roots: DataFrame,
    max_depth: int | None = None,
    forward: bool = False,
    with_steps: bool = False,
) -> tuple[DataFrame, int]:
    """Breadth-first levels from every root: (root, node, depth) with depth >= 1.

    A root on a cycle is reported with the length of its shortest cycle. Each round expands only
    the newest level and drops pairs already seen. ``with_steps`` adds the lexicographically first
    shortest path as an array, in edge direction: node to root, or root to node when ``forward``.
    Returns the table and the number of rounds.
    """
    step = graph.dependencies if forward else graph.dependents
    level = roots.select(F.col("root"), F.col("root").alias("at"))
    if with_steps:
        level = level.withColumn("steps", F.array("root"))
    seen: list[Written] = []
    rounds = 0
    while max_depth is None or rounds < max_depth:
        rounds += 1
        new = step(level, "at", "node")
        if with_steps:
            new = new.groupBy("root", "node").agg(F.min("steps").alias("steps"))
            grow = F.array_append if forward else F.array_prepend
            new = new.withColumn("steps", grow("steps", F.col("node")))
        else:
            new = new.select("root", "node").distinct()
        for old in _together(seen):
            new = new.join(old.select("root", "node"), ["root", "node"], "left_anti")
        done = materialize(new.withColumn("depth", F.lit(rounds)), "level")
        if done.rows == 0:
            done.drop()
            break
        seen.append(done)
        level = done.df.withColumnRenamed("node", "at").drop("depth")
    if not seen:
        empty = level.select("root", F.col("at").alias("node"), *(["steps"] if with_steps else []))
        return empty.withColumn("depth", F.lit(0)).limit(0), rounds
    return _together(seen)[0], rounds


def _reached(step, start: DataFrame) -> tuple[DataFrame, list[Written]]:
    """(node) of ``start`` and of all that steps lead to from there, whichever node they come from, and its tables."""
    seen = [materialize(start.select("node").distinct(), "reached")]
    while seen[-1].rows:
        new = step(seen[-1].df.select(F.col("node").alias("at")), "at", "next").select(F.col("next").alias("node")).distinct()
        seen.append(materialize(new.join(_together(seen)[0], "node", "left_anti"), "reached"))
    return _together(seen)[0], seen


def _above(graph: NumberedGraph, start: DataFrame) -> NumberedGraph:
    """The files of ``start`` and all that depend on them, with the links between these; ``graph`` is dropped."""
    found, levels = _reached(graph.dependents, start)
    nodes = materialize(graph.nodes.df.join(found.select(F.col("node").alias("nid")), "nid", "left_semi"), "nodes")
    # What depends on one of these files is one of them.
    out = salted_graph(nodes, graph.links.df.join(found.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    for p in levels:
        p.drop()
    graph.drop()
    return out


def _together(parts: list[Written]) -> list[DataFrame]:
    """All written levels as one scan (one reader over several folders, not a chain of unions)."""
    if not parts:
        return []
    spark = parts[0].df.sparkSession
    return [spark.read.schema(parts[0].df.schema).parquet(*[p.path for p in parts])]


def with_rating(df: DataFrame, nodes: DataFrame, column: str = "path", name: str = "rating") -> DataFrame:
    """Attach the rating of a file; unknown files count as 10."""
    r = nodes.select(F.col("id").alias(column), F.col("rating").alias(name))
    return df.join(r, column, "left").withColumn(name, F.coalesce(name, F.lit(UNKNOWN_RATING)))


def impact_set(
    edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 2, fragile_below: float = FRAGILE, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Files that would feel a change of each root, up to ``depth`` hops, which is taken as given.

    Output: root, path, depth, severity, rating, fragile. The root itself is left out.
    """
    if depth < 1:
        raise ValueError("depth is at least 1")
    hit = _walk(edges, roots.select("root").distinct(), depth, hot_share)
    return with_rating(hit, nodes).select(
        "root",
        "path",
        "depth",
        F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("severity"),
        "rating",
        (F.col("rating") < fragile_below).alias("fragile"),
    )


def transitive_dependents(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every file that depends on a root through any number of hops; a root on a cycle lists itself.

    Where the roots are few, the graph is first cut to what depends on them. Levels are walked between components only, since the
    files of one share their dependents. The pairs of files are made at the end, with names, ratings and the dependencies of the
    file already beside them, and are not shuffled again; the files of a component come in slices, so that no task makes
    all pairs of a large one.
    """
    from .components import condensed

    graph = number_graph(edges)
    sought = roots.select(F.col("root").alias("id")).distinct().withColumn("root", F.col("id"))
    chosen = materialize(graph.encode(sought, "id", "node"), "roots")
    if chosen.rows * FEW < graph.nodes.rows:
        graph = _above(graph, chosen.df)
    members, units = condensed(graph)
    m = members.df
    start = chosen.df.join(m, "node").select("root", F.col("node").alias("r"), F.col("unit").alias("at"), "cyclic")
    start = materialize(start, "roots").df
    chosen.drop()
    found, _ = reach(units, start.select(F.col("at").alias("root")).distinct())
    own = start.filter("cyclic").select("at", F.col("at").alias("unit")).distinct()
    pairs = found.select(F.col("root").alias("at"), F.col("node").alias("unit")).unionByName(own)
    slices = m.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("n"))
    split = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sought = pairs.join(slices, "unit").withColumn("slice", split(F.col("n"))).drop("n").join(start.select("root", "r", "at"), "at")
    sought = sought.select("root", "r", "unit", "slice").hint("merge")
    rated = nodes.select(F.col("id").alias("path"), "rating")
    named = graph.decode(m.select("node", "unit", F.col("node").alias("p")), "node", "path").join(rated, "path", "left")
    named = named.join(slices, "unit").withColumn("slice", F.pmod(F.xxhash64("p"), F.col("n")).cast("int")).drop("n")
    links = graph.links.df.select(F.col("dst").alias("r"), F.col("src").alias("p"))
    wide = materialize(links.groupBy("p").count().where(F.col("count") > WIDE).select("p"), "wide")
    narrow = links.join(wide.df, "p", "left_anti").groupBy("p").agg(F.collect_list("r").alias("on"))
    hit = sought.join(named.join(wide.df, "p", "left_anti").join(narrow, "p", "left"), ["unit", "slice"])
    hit = hit.select("root", "path", "rating", F.array_contains("on", F.col("r")).alias("direct"))
    if wide.rows:
        more = sought.join(named.join(wide.df, "p", "left_semi"), ["unit", "slice"]).join(links.withColumn("direct", F.lit(True)), ["r", "p"], "left")
        hit = hit.unionByName(more.select("root", "path", "rating", "direct"))
    return hit.select(
        "root",
        "path",
        F.coalesce("direct", F.lit(False)).alias("direct"),
        "rating",
        F.coalesce(F.col("rating") < FRAGILE, F.lit(False)).alias("at_risk"),
    )


def _hubs(units: NumberedGraph, sizes: DataFrame) -> Written:
    """(node, hub) of the units that are joined by links, either way, with a unit of several files: the largest such.

    Parts of the graph that take more than HUB_ROUNDS rounds to agree on one have none.
    """
    links = units.links.df.select("src", "dst")
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = sizes.select(F.col("unit").alias("node"), F.struct("files", "unit").alias("best"), F.lit(True).alias("fresh"))
    state, rounds = materialize(start, "hub", where=F.col("fresh")), 0
    while state.hits and rounds < HUB_ROUNDS:
        offer = both.join(state.df.filter("fresh").select(F.col("node").alias("src"), "best"), "src")
        offer = offer.groupBy(F.col("dst").alias("node")).agg(F.max("best").alias("new"))
        fresh = F.coalesce(F.col("new") > F.col("best"), F.lit(False)).alias("fresh")
        after = state.df.join(offer, "node", "left").select("node", F.greatest("best", "new").alias("best"), fresh)
        after, rounds = materialize(after, "hub", where=F.col("fresh")), rounds + 1
        state.drop()
        state = after
    label = state.df.select("node", F.col("best.unit").alias("hub"), F.col("best.files").alias("files"))
    if state.hits:
        end = lambda name, to: label.select(F.col("node").alias(name), F.col("hub").alias(to))
        apart = links.join(end("src", "a"), "src").join(end("dst", "b"), "dst").filter("a <> b")
        label = label.join(apart.select(F.explode(F.array("a", "b")).alias("hub")).distinct(), "hub", "left_anti")
    out = materialize(label.filter("files > 1").select("node", "hub"), "hubs", where=F.col("node") == F.col("hub"))
    state.drop()
    return out


def _around_hubs(units: NumberedGraph, sizes: DataFrame) -> tuple[NumberedGraph, Written | None]:
    """Links that are left to walk, and (unit, base): how many dependents of a unit the links left out stand for.

    What a hub depends on has the hub and all that depends on it among its dependents, so these are counted once for
    each hub. The other dependents of such a unit reach it without touching them; these ways are walked apart, by links between
    the units ``-1 - unit``.
    """
    label = _hubs(units, sizes)
    if not label.hits:
        label.drop()
        return units, None
    hubs = label.df.filter("node = hub").select("node")
    above, up = _reached(units.dependents, hubs)
    below, down = _reached(units.dependencies, hubs)
    side, beside = _reached(units.dependents, below)
    files = lambda df: df.join(label.df, "node").join(sizes.withColumnRenamed("unit", "node"), "node")
    all_above = files(above).groupBy("hub").agg(F.sum("files").alias("base"))
    own = F.when(F.col("node") == F.col("hub"), F.col("files")).otherwise(0)
    base = materialize(files(below).join(all_above, "hub").select(F.col("node").alias("unit"), (F.col("base") - own).alias("base")), "hub-base")
    end = lambda df, column: df.select(F.col("node").alias(column))
    links = units.links.df.select("src", "dst")
    apart = links.join(end(above, "src"), "src", "left_anti").join(end(side, "dst"), "dst", "left_semi")
    apart = apart.select((-1 - F.col("src")).alias("src"), (-1 - F.col("dst")).alias("dst"))
    left = salted_graph(units.nodes, links.join(end(below, "dst"), "dst", "left_anti").select("src", "dst").unionByName(apart))
    for p in [label, *up, *down, *beside, units.links]:
        p.drop()
    return left, base


def closure_sizes(edges: DataFrame, nodes: DataFrame, lg_entries: int = 12) -> DataFrame:
    """Number of files that depend on each file through any number of hops, for all files at once.

    No pair of files is ever listed: every component carries a sketch (theta, 2^``lg_entries`` hashes at most) of its
    dependents outside it, as they are the same for all its files. A round hands the sketches that changed in the last one to the
    components depended on, so the rounds follow the longest path between components. What depends on the largest component
    of a part of the graph is counted once for all that this component depends on, and takes no place in their sketches. Output: path, dependents, exact.
    Counts of fewer than 2^lg_entries files are exact; larger ones have a relative standard error of
    1 / sqrt(2^lg_entries - 1). A file on a cycle counts itself, a
    file that nothing depends on has 0, and ids of ``edges`` outside ``nodes`` count as dependents only.
    """
    from .components import condensed

    graph = number_graph(edges)
    members, units = condensed(graph)
    merged = lambda c: F.theta_union_agg(c, lg_entries)
    own = members.df.groupBy("unit").agg(F.theta_sketch_agg("node", lg_entries).alias("own"), F.first("cyclic").alias("cyclic"), F.count(F.lit(1)).alias("files"))
    own = materialize(own, "closure-own")
    units, base = _around_hubs(units, own.df.select("unit", "files"))
    start = own.df.select(F.col("unit").alias("at"), F.col("own").alias("sketch"))
    if base:
        start = start.unionByName(start.withColumn("at", -1 - F.col("at")))
    first = units.dependencies(start, "at", "node")
    first = first.groupBy("node").agg(merged("sketch").alias("sketch"))
    parts = [materialize(first.withColumn("round", F.lit(0)), "closure")]
    fresh = parts[0].df
    while True:
        flow = units.dependencies(fresh.select(F.col("node").alias("at"), "sketch"), "at", "node")
        gain = flow.groupBy("node").agg(merged("sketch").alias("gain"))
        # What a file had: its newest version. Versions are few, as a file is written only in rounds that change it.
        had = _together(parts)[0].join(gain.select("node"), "node", "left_semi")
        had = had.groupBy("node").agg(F.max_by("sketch", "round").alias("had"))
        new = gain.join(had, "node", "left").withColumn("sketch", F.coalesce(F.theta_union("had", "gain", lg_entries), "gain"))
        new = new.where(~F.col("sketch").eqNullSafe(F.col("had"))).select("node", "sketch", F.lit(len(parts)).alias("round"))
        done = materialize(new, "closure")
        parts.append(done)
        if not done.rows:
            break
        fresh = done.df
    last = _together(parts)[0].groupBy(F.col("node").alias("unit")).agg(F.max_by("sketch", "round").alias("sketch"))
    if base:
        apart = last.filter("unit < 0").withColumn("unit", -1 - F.col("unit"))
        last = last.filter("unit >= 0").unionByName(apart.join(base.df.select("unit"), "unit", "left_semi"))
    every = own.df.join(last, "unit", "left").withColumn("own", F.when(F.col("cyclic"), F.col("own")))
    every = every.withColumn("sketch", F.coalesce(F.theta_union("sketch", "own", lg_entries), "sketch", "own"))
    n = F.coalesce(F.theta_sketch_estimate("sketch"), F.lit(0).cast("long"))
    if base:
        every = every.join(base.df, "unit", "left")
        n = n + F.coalesce("base", F.lit(0).cast("long"))
    counted = every.select("unit", n.alias("n"))
    sizes = graph.decode(members.df.select("node", "unit").join(counted, "unit").select("node", "n"), "node", "path")
    sizes = materialize(sizes, "closure-sizes").df
    for p in [*parts, own, members, units.links, *([base] if base else [])]:
        p.drop()
    graph.drop()
    n = F.coalesce("n", F.lit(0).cast("long"))
    known = nodes.select(F.col("id").alias("path")).join(sizes, "path", "left")
    return known.select("path", n.alias("dependents"), (n < (1 << lg_entries)).alias("exact"))


def shortest_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, forward_only: bool = False) -> DataFrame:
    """Shortest dependency path of each (source, target) pair, else the path the other way round.

    Levels grow over all pairs at once and carry the path; the least path per file is kept, so the
    result is the lexicographically first shortest path. Output: source, target, direction (forward / reverse / none), path (array
    of ids), length (hops) and bottlenecks (files rated below 6).
    """
    pairs = pairs.select("source", "target").distinct()
    graph = number_graph(
        edges,
        pairs.select(F.col("source").alias("id")).union(pairs.select(F.col("target").alias("id"))),
    )
    coded = materialize(graph.encode(graph.encode(pairs, "source", "s"), "target", "t"), "pairs").df
    fwd = _trace(graph, coded).withColumn("direction", F.lit("forward"))
    if not forward_only:
        rest = coded.join(fwd.select("s", "t"), ["s", "t"], "left_anti")
        rest = materialize(rest.select(F.col("t").alias("s"), F.col("s").alias("t")), "pairs")
        if rest.rows:
            back = _trace(graph, rest.df).select(
                F.col("t").alias("s"), F.col("s").alias("t"), "steps", F.lit("reverse").alias("direction")
            )
            fwd = fwd.unionByName(back)
    steps = fwd.select("s", "t", "direction", F.posexplode("steps").alias("i", "nid"))
    named = graph.decode(steps, "nid", "id").join(nodes.select("id", "rating"), "id", "left")
    # One path has at most as many entries as the graph's diameter, so this group stays small.
    lines = named.groupBy("s", "t", "direction").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("path"),
        F.count_if(F.coalesce("rating", F.lit(UNKNOWN_RATING)) < FRAGILE).alias("bottlenecks"),
    )
    out = coded.join(lines, ["s", "t"], "left")
    out = graph.decode(graph.decode(out, "s", "source"), "t", "target")
    return out.select(
        "source",
        "target",
        F.coalesce("direction", F.lit("none")).alias("direction"),
        "path",
        (F.size("path") - 1).alias("length"),
        "bottlenecks",
    )


def _trace(graph: NumberedGraph, pairs: DataFrame) -> DataFrame:
    """Shortest paths of numbered pairs along the edges: (s, t, steps).

    Levels start from whichever side has fewer distinct files.
    """
    n = pairs.agg(F.count_distinct("s").alias("s"), F.count_distinct("t").alias("t")).first()
    forward = n["s"] < n["t"]
    a, b = ("s", "t") if forward else ("t", "s")
    found, _ = reach(graph, pairs.select(F.col(a).alias("root")).distinct(), forward=forward, with_steps=True)
    paths = found.select(F.col("root").alias(a), F.col("node").alias(b), "steps")
    trivial = pairs.filter("s = t").select("s", "t", F.array("s").alias("steps"))
    return pairs.filter("s <> t").join(paths, ["s", "t"]).select("s", "t", "steps").unionByName(trivial)
