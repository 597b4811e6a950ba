"""Filters of a view: types, ids, globs, collapse, roots, neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import filtered_out
from ..model import GraphTables, GraphView

G = "graph_id"


def edge_type_filter(edges: DataFrame, hidden: frozenset[int]) -> DataFrame:
    return edges.filter(~F.col("type_id").isin(*hidden)) if hidden else edges


def hidden_by_type(nodes: DataFrame, hidden: frozenset[int]) -> Column:
    return F.col("type_id").isin(*hidden) if hidden else F.lit(False)


def glob_filter(nodes: DataFrame, view: GraphView) -> DataFrame:
    """Nodes that the globs let through."""
    return nodes.filter(~filtered_out(F.col("label"), view.includeGlobs, view.excludeGlobs))


def hidden_ids(nodes: DataFrame, view: GraphView) -> Column:
    """Hidden one by one, or by the globs: a column over nodes."""
    own = F.col("id").isin(*view.hiddenNodes) if view.hiddenNodes else F.lit(False)
    globs = view.includeGlobs or view.excludeGlobs
    return own | filtered_out(F.col("label"), view.includeGlobs, view.excludeGlobs) if globs else own


def effective_hidden(tables: GraphTables, view: GraphView) -> DataFrame:
    """(graph_id, idx, id) of explicitly hidden and filtered-out nodes."""
    return tables.nodes.filter(hidden_ids(tables.nodes, view)).select(G, "idx", "id")


def roots(tables: GraphTables, view: GraphView) -> DataFrame:
    """(graph_id, idx) of the declared roots; unknown ids drop out."""
    return tables.nodes.filter(F.col("id").isin(*view.rootNodes) if view.rootNodes else F.lit(False)).select(G, "idx")


def inverted(tables: GraphTables, view: GraphView) -> DataFrame:
    """(graph_id, idx): direct targets of collapsed nodes."""
    at = tables.nodes.filter(F.col("id").isin(*view.collapsed) if view.collapsed else F.lit(False)).select(G, F.col("idx").alias("src"))
    return tables.edges.join(F.broadcast(at), [G, "src"]).select(G, F.col("dst").alias("idx")).distinct()


def incident_edges(edges: DataFrame, idx: int) -> DataFrame:
    return edges.filter((F.col("src") == idx) | (F.col("dst") == idx))


def in_view(x: Column, y: Column, camera: tuple[float, float, float], width: float, height: float, margin: float = 0.85) -> Column:
    """Whether a world point is on the screen, a margin inside its edges."""
    cx, cy, zoom = camera
    return (F.abs(x - cx) <= margin * width / (2 * zoom)) & (F.abs(y - cy) <= margin * height / (2 * zoom))


def edges_worth_drawing(length: Column, zoom: float, least_px: float = 1.5) -> Column:
    return length * zoom >= least_px


def cycles_only(tables: GraphTables, view: GraphView, contracted: DataFrame | None) -> DataFrame:
    """(graph_id, idx) of the visible nodes; with ``cyclesOnly`` only those on a
    cycle of the current contraction, under the view's edge filter."""
    from .contract import contracted_edges
    from .traverse import components

    visible = (tables.nodes if contracted is None else contracted.filter(~F.col("hidden"))).select("graph_id", "idx")
    if not view.cyclesOnly:
        return visible
    edges = contracted_edges(edge_type_filter(tables.edges, view.hiddenEdgeTypes), contracted)
    return visible.join(components(edges).select("graph_id", "idx"), ["graph_id", "idx"], "left_semi")
