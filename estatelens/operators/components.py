"""Cycles as strongly connected components, and elementary cycles inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Written, materialize
from .traverse import NumberedGraph, number_graph, salted_graph


def _trim(links: Written) -> Written:
    """Drop edges from files nobody depends on and to files without dependencies, round by round.

    Such edges lie on no cycle. Stops when a round removes less than one edge in fifty: colouring
    takes care of the rest.
    """
    while links.rows:
        ins = links.df.select(F.col("dst").alias("src")).distinct()
        outs = links.df.select(F.col("src").alias("dst")).distinct()
        kept = materialize(links.df.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "scc")
        removed = links.rows - kept.rows
        links.drop()
        links = kept
        if removed * 50 < links.rows or not removed:
            break
    return links


def _shorten(links: Written) -> tuple[Written, DataFrame, DataFrame] | None:
    """Replace chains of files with one edge in and one out by a single edge; None where they are few.

    Returns the shorter edges, the files of the chains (node, a, z: the files before and after the chain), and the
    files of rings that have no other edges (node, root: the least file of the ring). Both ends of a chain are found by
    pointer doubling, so rounds follow the logarithm of its length.
    """
    ins = links.df.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("a"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    outs = links.df.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("z"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    inner = materialize(ins.join(outs, "node"), "chain")
    if not inner.rows or inner.rows * 50 < links.rows:
        inner.drop()
        return None
    state = materialize(inner.df.withColumn("low", F.col("node")), "chain", where=F.lit(True))
    reach = 1
    while state.hits and reach < inner.rows:
        before = state.df.select(F.col("node").alias("a"), F.col("a").alias("aa"))
        after = state.df.select(F.col("node").alias("z"), F.col("z").alias("zz"), F.col("low").alias("l"))
        both = state.df.join(before, "a", "left").join(after, "z", "left")
        new = both.select(
            "node", F.coalesce("aa", "a").alias("a"), F.coalesce("zz", "z").alias("z"), F.least("low", "l").alias("low"),
            (F.col("aa").isNotNull() | F.col("zz").isNotNull()).alias("moved"),
        )
        new = materialize(new, "chain", where=F.col("moved"))
        state.drop()
        state, reach = new, 2 * reach
    # What still points into a chain after as many steps as there are such files goes round in a ring.
    inside = inner.df.select(F.col("node").alias("z"))
    rings = state.df.join(inside, "z", "left_semi").select("node", F.col("low").alias("root"))
    chains = materialize(state.df.join(inside, "z", "left_anti").select("node", "a", "z"), "chain").df
    gone = inner.df.select("node")
    rest = links.df.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    short = rest.select("src", "dst").unionByName(chains.select(F.col("a").alias("src"), F.col("z").alias("dst")).filter("src <> dst")).distinct()
    short = materialize(short, "scc")
    links.drop()
    return short, chains, rings


def _with_chains(members: DataFrame, chains: DataFrame) -> DataFrame:
    """Members (node, root) with the files of the chains whose two ends share a component.

    An end without a component yet is one of its own: a chain that comes back to it makes a cycle.
    """
    a = members.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    z = members.select(F.col("node").alias("z"), F.col("root").alias("rz"))
    placed = chains.join(a, "a", "left").join(z, "z", "left")
    placed = placed.filter(F.coalesce("ra", "a") == F.coalesce("rz", "z")).select("node", F.coalesce("ra", "a").alias("root"), "a", F.col("ra").isNull().alias("new"))
    ends = placed.filter("new").select(F.col("a").alias("node"), "root").distinct()
    return materialize(members.unionByName(placed.select("node", "root")).unionByName(ends), "members").df


def _colours(links: DataFrame) -> Written:
    """For each node the greatest node that reaches it (``fw``) and that it reaches (``bw``), itself included.

    Both directions advance in the same round, and only values that changed are passed on.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    start = nodes.select("node", F.col("node").alias("fw"), F.col("node").alias("bw"), F.lit(True).alias("df"), F.lit(True).alias("db"))
    state = materialize(start, "colour", where=F.lit(True))
    none = F.lit(None).cast("long")
    while state.hits:
        # Messages are reduced per receiver map-side, so a node with very many neighbours stays cheap.
        fw = links.join(state.df.filter("df").select(F.col("node").alias("src"), F.col("fw").alias("f")), "src")
        bw = links.join(state.df.filter("db").select(F.col("node").alias("dst"), F.col("bw").alias("b")), "dst")
        news = (
            fw.select(F.col("dst").alias("node"), "f", none.alias("b"))
            .unionAll(bw.select(F.col("src").alias("node"), none.alias("f"), "b"))
            .groupBy("node")
            .agg(F.max("f").alias("f"), F.max("b").alias("b"))
        )
        df, db = F.coalesce(F.col("f") > F.col("fw"), F.lit(False)), F.coalesce(F.col("b") > F.col("bw"), F.lit(False))
        nxt = state.df.select("node", "fw", "bw").join(news, "node", "left")
        nxt = nxt.select("node", F.greatest("fw", "f").alias("fw"), F.greatest("bw", "b").alias("bw"), df.alias("df"), db.alias("db"))
        new = materialize(nxt, "colour", where=F.col("df") | F.col("db"))
        state.drop()
        state = new
    return state


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Strongly connected component of every node that lies on a cycle.

    Output: path, component (its least member), size. A file that depends on itself is a cycle of one.
    """
    graph = number_graph(edges)
    named = graph.decode(graph.decode(numbered_components(graph), "node", "path"), "component", "c")
    return named.select("path", F.col("c").alias("component"), "size")


def numbered_components(graph: NumberedGraph) -> DataFrame:
    """Components of a numbered graph: node, component, size.

    Edges outside any cycle are trimmed and chains shortened first. Nodes whose two colours agree form the component of that colour. Members of one component
    share both colours, so every edge between different colours is dropped; the rest is coloured
    again until no edge is left.
    """
    links0 = graph.links.df.select("src", "dst")
    loops = links0.filter("src = dst").select(F.col("src").alias("node"))
    links = materialize(links0.filter("src <> dst"), "scc")
    members = links.df.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    shortened: list[DataFrame] = []
    while True:
        links = _trim(links)
        if not links.rows:
            break
        short = _shorten(links)
        if short:
            links, chains, rings = short
            shortened.append(chains)
            members = members.unionByName(rings)
            continue
        colours = _colours(links.df)
        # A component of one file is not a cycle; a chain that leads back to it adds it later.
        found = colours.df.filter("fw = bw").select("node", F.col("fw").alias("root"))
        members = members.unionByName(found)
        open_nodes = colours.df.filter("fw <> bw").select("node", "fw", "bw")
        s = open_nodes.select(F.col("node").alias("src"), "fw", "bw")
        t = open_nodes.select(F.col("node").alias("dst"), "fw", "bw")
        nxt = materialize(links.df.join(s, "src").join(t, ["dst", "fw", "bw"]).select("src", "dst"), "scc")
        links.drop()
        links = nxt
    for chains in reversed(shortened):
        members = _with_chains(members, chains)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("component")).filter("size > 1")
    out = members.join(sizes, "root").select("node", "component", "size")
    single = loops.withColumn("component", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    return out.unionByName(single.join(out.select("node"), "node", "left_anti"))


def condensed(graph: NumberedGraph) -> tuple[Written, NumberedGraph]:
    """The graph with one unit for each component: (node, unit, cyclic) of all nodes, and the links between units.

    The units' graph has no cycles. Files of a unit have the same dependents and dependencies outside it.
    """
    comp = numbered_components(graph).select("node", "component")
    unit = F.coalesce("component", "node").alias("unit")
    of = graph.nodes.df.select(F.col("nid").alias("node")).join(comp, "node", "left")
    members = materialize(of.select("node", unit, F.col("component").isNotNull().alias("cyclic")), "units")
    at = lambda end, name: members.df.select(F.col("node").alias(end), F.col("unit").alias(name))
    between = graph.links.df.select("src", "dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a <> b")
    return members, salted_graph(graph.nodes, between.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def cycle_summary(components: DataFrame) -> DataFrame:
    """One row per cycle group."""
    return components.select("component", "size").distinct()


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside a component."""
    s = components.select(F.col("path").alias("source"), F.col("component"))
    t = components.select(F.col("path").alias("target"), F.col("component").alias("_ct"))
    return edges.join(s, "source").join(t, "target").filter("component = _ct").drop("_ct")


def elementary_cycles(edges: DataFrame, components: DataFrame, max_length: int = 5) -> DataFrame:
    """Elementary cycles of up to ``max_length`` files, each once, starting at its least member."""
    inside = cycle_edges(edges, components).select("source", "target", "component").distinct()
    inside = materialize(inside, "cycle").df
    walk = inside.filter("target >= source").select(
        F.array("source").alias("path"), F.col("source").alias("start"), F.col("target").alias("at")
    )
    found = walk.filter("at = start").select("path")
    walk = walk.filter("at > start")
    step = inside.select(F.col("source").alias("at"), F.col("target").alias("to"))
    for _ in range(max_length - 1):
        walk = walk.select(F.array_append("path", F.col("at")).alias("path"), "start", "at")
        walk = walk.join(step, "at").select("path", "start", F.col("to").alias("at"))
        walk = walk.filter("at = start OR (at > start AND NOT array_contains(path, at))")
        found = found.unionByName(walk.filter("at = start").select("path"))
        walk = walk.filter("at > start")
    return found.select(F.col("path").alias("cycle"), F.size("path").alias("length"))
