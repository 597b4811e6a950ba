"""Contraction: hidden nodes are folded into the visible node that owns them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MISSING, GraphTables, GraphView
from ..runtime import settle
from . import walks
from .filters import hidden_by_type, hidden_ids, inverted

G = "graph_id"


def visibility(tables: GraphTables, view: GraphView) -> DataFrame:
    """(graph_id, idx, id_hidden, hidden). Hidden by id wins; else hidden by
    type, turned round for direct targets of collapsed nodes. Placeholders of a
    hidden ``missing`` type count as hidden by id: they are never folded."""
    by_type = hidden_by_type(tables.nodes, view.hiddenNodeTypes)
    by_id = hidden_ids(tables.nodes, view) | (by_type & (F.col("type") == MISSING))
    own = tables.nodes.select(G, "idx", by_id.alias("id_hidden"), by_type.alias("by_type"))
    turned = inverted(tables, view).withColumn("turned", F.lit(True))
    both = own.join(turned, [G, "idx"], "left")
    hidden = F.when(F.col("id_hidden"), True).otherwise(F.col("by_type") != F.coalesce("turned", F.lit(False)))
    return both.select(G, "idx", "id_hidden", hidden.alias("hidden"))


def owners(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, idx, rep) of hidden nodes that have an owner.

    The rule is sequential: first, in edge order, an edge from a visible node
    gives its source; then passes over the edges between hidden nodes, in edge
    order, hand owners on until nothing changes. That is an earliest-arrival
    problem: an owner arrives at (pass, edge), goes on in the same pass along
    later edges and in the next along earlier ones; the least arrival stays, and
    its edge names the node whose owner goes on. Up to walks.KERNEL_EDGES edges
    into hidden nodes are followed in the driver's memory, more by joins.
    """
    m = mask.filter("not id_hidden")
    end = lambda name: m.select(G, F.col("idx").alias(name), F.col("hidden").alias(f"h_{name}"))
    e = settle(edges.join(end("src"), [G, "src"]).join(end("dst"), [G, "dst"]).filter("h_dst and h_src is not null").select(G, "eidx", "src", "dst", "h_src"))
    if walks.fits(e):
        return walks.owners(e)
    direct = e.filter("not h_src").groupBy(G, F.col("dst").alias("idx")).agg(F.min(F.struct(F.lit(0).alias("round"), F.col("eidx"), F.col("src").alias("up"))).alias("t"))
    inner = settle(e.filter("h_src").select(G, "eidx", F.col("src").alias("idx"), "dst"))
    best = front = settle(direct)
    while not front.isEmpty():
        step = front.join(inner, [G, "idx"])
        later = (F.col("t.round") > 0) & (F.col("eidx") > F.col("t.eidx"))
        came = step.select(G, F.col("dst").alias("to"), F.struct((F.col("t.round") + F.when(later, 0).otherwise(1)).alias("round"), F.col("eidx"), F.col("idx").alias("up")).alias("c")).groupBy(G, F.col("to").alias("idx")).agg(F.min("c").alias("c"))
        both = settle(best.join(came, [G, "idx"], "full").select(G, "idx", F.least("t", "c").alias("t"), F.coalesce(F.col("c") < F.col("t"), F.col("t").isNull()).alias("new")))
        best, front = both.drop("new"), both.filter("new").drop("new")
    # owners along the edges of least arrival, in doubling steps
    known = best.select(G, "idx", "t.up", F.when(F.col("t.round") == 0, F.col("t.up")).alias("rep"))
    while not known.filter("rep is null").isEmpty():
        above = known.select(G, F.col("idx").alias("up"), F.col("up").alias("up2"), F.col("rep").alias("rep2"))
        known = settle(known.join(above, [G, "up"], "left").select(G, "idx", F.coalesce("up2", "up").alias("up"), F.coalesce("rep", "rep2").alias("rep")))
    return known.select(G, "idx", "rep")


def contraction(tables: GraphTables, view: GraphView, radii: DataFrame) -> DataFrame | None:
    """(graph_id, idx, hidden, rep, eff_radius), rep null where a hidden node
    has no owner; None if the view hides nothing. A visible node's area grows
    by that of the nodes it owns."""
    if not (view.hiddenNodeTypes or view.collapsed or view.hiddenNodes or view.includeGlobs or view.excludeGlobs):
        return None
    mask = settle(visibility(tables, view))
    own = owners(mask, tables.edges)
    both = settle(mask.join(own, [G, "idx"], "left").join(radii, [G, "idx"]).select(G, "idx", "hidden", F.when(~F.col("hidden"), F.col("idx")).otherwise(F.col("rep")).alias("rep"), "radius"))
    taken = both.filter("hidden and rep is not null").groupBy(G, F.col("rep").alias("idx")).agg(F.sum(F.col("radius") * F.col("radius")).alias("area"))
    grown = F.when(F.col("hidden"), 0.0).when(F.col("area") > 0, F.sqrt(F.col("radius") * F.col("radius") + F.col("area"))).otherwise(F.col("radius"))
    return both.join(taken, [G, "idx"], "left").select(G, "idx", "hidden", "rep", grown.alias("eff_radius"))


def contracted_edges(edges: DataFrame, contracted: DataFrame | None) -> DataFrame:
    """(graph_id, eidx, src, dst) between owners: dropped ends and self-loops
    go, and of parallel edges the first stays, with its index."""
    if contracted is None:
        return edges.select(G, "eidx", "src", "dst")
    end = lambda name: contracted.select(G, F.col("idx").alias(name), F.col("rep").alias(f"r_{name}")).filter(F.col(f"r_{name}").isNotNull())
    mapped = edges.join(end("src"), [G, "src"]).join(end("dst"), [G, "dst"]).filter("r_src <> r_dst")
    return mapped.groupBy(G, F.col("r_src").alias("src"), F.col("r_dst").alias("dst")).agg(F.min("eidx").alias("eidx")).select(G, "eidx", "src", "dst")


def fingerprint(contracted: DataFrame) -> DataFrame:
    """(graph_id, print): an order-free hash of the owners."""
    return contracted.groupBy(G).agg(F.bit_xor(F.xxhash64("idx", F.coalesce("rep", F.lit(-1)))).alias("print"))
