"""Traversals as checkpointed loops: cycles, components, orphans, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import visual_key
from ..runtime import MAX_ROUNDS, settle
from . import walks

G = "graph_id"


def _plain(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(G, "src", "dst").distinct()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """What is left of the edges when nodes without an edge in, or without one
    out, are taken away again and again: empty where nothing is cyclic."""
    e = settle(_plain(edges))
    n = e.count()
    while True:  # every round takes an edge away, or ends
        left = e.join(e.select(G, F.col("dst").alias("src")).distinct(), [G, "src"], "left_semi").join(e.select(G, F.col("src").alias("dst")).distinct(), [G, "dst"], "left_semi")
        e = settle(left.select(G, "src", "dst"))
        was, n = n, e.count()
        if n in (0, was):
            return e


def has_any_cycle(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, has_cycle) for every graph of ``graphs``."""
    hit = cyclic_core(edges).select(G).distinct().withColumn("has_cycle", F.lit(True))
    return graphs.select(G).distinct().join(hit, G, "left").select(G, F.coalesce("has_cycle", F.lit(False)).alias("has_cycle"))


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, idx): start and all that can be reached from it."""
    e = edges.select(G, F.col("src").alias("idx"), "dst")
    seen = front = settle(start.select(G, "idx").distinct())
    for _ in range(MAX_ROUNDS * 50):
        new = settle(front.join(e, [G, "idx"]).select(G, F.col("dst").alias("idx")).distinct().join(seen, [G, "idx"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, front = settle(seen.unionByName(new)), new
    raise RuntimeError("the traversal did not end")


def components(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, scc): members of strongly connected components of two
    nodes or more; scc is the component's largest index.

    Colours (largest index that reaches a node) are pushed forward until
    stable; from each colour's own node, a walk backward inside the colour
    confirms its component, which is then taken out.
    """
    left = cyclic_core(edges)
    found = None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        ids = left.select(G, F.col("src").alias("idx")).unionByName(left.select(G, F.col("dst").alias("idx"))).distinct()
        colour = settle(ids.withColumn("c", F.col("idx")))
        for _ in range(MAX_ROUNDS * 50):
            came = left.join(colour.withColumnRenamed("idx", "src"), [G, "src"]).select(G, F.col("dst").alias("idx"), F.col("c").alias("c2")).groupBy(G, "idx").agg(F.max("c2").alias("c2"))
            new = settle(colour.join(came, [G, "idx"], "left").select(G, "idx", F.greatest("c", "c2").alias("n"), "c"))
            moved = not new.filter("n <> c").isEmpty()
            colour = new.select(G, "idx", F.col("n").alias("c"))
            if not moved:
                break
        paint = lambda end: colour.select(G, F.col("idx").alias(end), F.col("c").alias(f"c_{end}"))
        inside = settle(left.join(paint("src"), [G, "src"]).join(paint("dst"), [G, "dst"]).filter("c_src = c_dst").select(G, "src", "dst"))
        back = inside.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = reachable(colour.filter("idx = c"), back).join(colour, [G, "idx"]).select(G, "idx", F.col("c").alias("scc"))
        big = members.join(members.groupBy(G, "scc").agg(F.count("*").alias("k")).filter("k > 1").select(G, "scc"), [G, "scc"], "left_semi")
        found = settle(big if found is None else found.unionByName(big.select(*found.columns)))
        done = settle(members.select(G, "idx"))
        left = cyclic_core(left.join(done.withColumnRenamed("idx", "src"), [G, "src"], "left_anti").join(done.withColumnRenamed("idx", "dst"), [G, "dst"], "left_anti"))
    else:
        raise RuntimeError("components did not settle")
    return (found if found is not None else left.select(G, F.col("src").alias("idx"), F.col("dst").alias("scc"))).select(G, "idx", "scc")


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(graph_id, idx) of nodes that neither a cycle nor a root reaches: just
    those that peeling nodes without an edge in, roots apart, takes away."""
    core = cyclic_core(edges)
    fixed = core.select(G, F.col("src").alias("idx"))
    # the core may hold paths between cycles; all of it is behind a cycle
    safe = reachable(fixed.unionByName(roots.select(G, "idx")) if roots is not None else fixed, _plain(edges))
    return nodes.select(G, "idx").join(safe, [G, "idx"], "left_anti")


def has_any_orphan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, has_orphan): some node has no edge in; roots do not matter."""
    bare = nodes.select(G, "idx").join(edges.select(G, F.col("dst").alias("idx")), [G, "idx"], "left_anti").select(G).distinct().withColumn("has_orphan", F.lit(True))
    return nodes.select(G).distinct().join(bare, G, "left").select(G, F.coalesce("has_orphan", F.lit(False)).alias("has_orphan"))


def _prune(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges inside one component."""
    s = lambda end: scc.select(G, F.col("idx").alias(end), F.col("scc").alias(f"s_{end}"))
    return edges.join(s("src"), [G, "src"]).join(s("dst"), [G, "dst"]).filter("s_src = s_dst").select(G, "eidx", "src", "dst")


def lexmin_paths(starts: DataFrame, edges: DataFrame, close: DataFrame | None = None, on_first: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(graph_id, start, goal, path): shortest walks from each start to its
    goal (a first edge leads away); of equal ones the least by edge order.

    starts: graph_id, start, goal. Each level keeps one path for a (start,
    goal, node), which makes the search equal to a queue's in edge order.
    path is an array of (eidx, src) steps. close maps nodes to goals (goal =
    the node itself where it is None). on_first is called once, with the first
    paths that are found, long before the longest are.
    """
    e = edges.select(G, F.col("src").alias("node"), F.struct("eidx", "src").alias("step"), "dst")
    if close is not None:
        e = e.join(close.select(G, F.col("idx").alias("dst"), F.col("rep").alias("hit")), [G, "dst"])
    else:
        e = e.withColumn("hit", F.col("dst"))
    e = settle(e)
    state = settle(starts.select(G, "start", "goal", F.col("start").alias("node"), F.array().cast(f"array<{e.schema['step'].dataType.simpleString()}>").alias("path")))
    seen, found, key = state.select(G, "start", "goal", "node"), None, [G, "start", "goal"]
    while True:  # a level reaches new nodes, or ends
        grown = state.join(e, [G, "node"]).select(*key, F.col("dst").alias("node"), "hit", F.concat("path", F.array("step")).alias("path"))
        best = settle(grown.groupBy(*key, "node", "hit").agg(F.min("path").alias("path")))
        done = settle(best.filter("hit = goal").groupBy(*key).agg(F.min("path").alias("path")))
        found = done if found is None else settle(found.unionByName(done))
        if on_first and not done.isEmpty():
            on_first(done)
            on_first = None
        onward = best.filter(F.col("hit") == F.col("start")) if close is not None else best
        state = settle(onward.join(done, key, "left_anti").join(seen, [*key, "node"], "left_anti").select(*key, "node", "path"))
        if state.isEmpty():
            return found
        seen = settle(seen.unionByName(state.select(*key, "node")))


def shortest_cycles(edges: DataFrame, scc: DataFrame | None = None, on_first: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(graph_id, seq, cycle): the shortest cycle through each node of a
    component, first of each visual key by start node, shortest first.
    on_first is called once, as soon as any cycle is known. Up to
    walks.KERNEL_EDGES edges are searched in each task's memory, more by joins."""
    plain = edges.filter("src <> dst")
    if scc is None and walks.fits(plain):
        return ordered_cycles(walks.cycles(plain, on_first))
    scc = components(edges) if scc is None else scc
    inner = settle(_prune(edges.filter("src <> dst"), scc))
    starts = scc.select(G, F.col("idx").alias("start"), F.col("idx").alias("goal"))
    raw = lexmin_paths(starts, inner, on_first=on_first).select(G, "start", F.transform("path", lambda s: s["src"]).alias("cycle"))
    return ordered_cycles(raw)


def ordered_cycles(raw: DataFrame) -> DataFrame:
    """First of each visual key by ``start``, then by length and start."""
    first = raw.groupBy(G, visual_key(F.col("cycle")).alias("key")).agg(F.min_by(F.struct("start", "cycle"), "start").alias("x")).select(G, "x.start", "x.cycle")
    return first.withColumn("seq", F.struct(F.size("cycle").alias("size"), F.col("start"))).select(G, "seq", "start", "cycle")


def shortest_cycle_lengths(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, length) of every node on a cycle."""
    plain = edges.filter("src <> dst")
    if walks.fits(plain):
        return walks.lengths(plain)
    scc = components(edges)
    inner = settle(_prune(edges.filter("src <> dst"), scc))
    starts = scc.select(G, F.col("idx").alias("start"), F.col("idx").alias("goal"))
    return lexmin_paths(starts, inner).select(G, F.col("start").alias("idx"), F.size("path").alias("length"))


def empty_reason(graphs: DataFrame, edges: DataFrame, listed: DataFrame) -> DataFrame:
    """(graph_id, reason): none if cycles are listed, graph if there is none
    under the edge filter, scoped if only the view hides them."""
    flags = has_any_cycle(graphs, edges).join(listed.select(G).distinct().withColumn("listed", F.lit(True)), G, "left")
    return flags.select(G, F.when(F.col("listed"), "none").when(~F.col("has_cycle"), "graph").otherwise("scoped").alias("reason"))
