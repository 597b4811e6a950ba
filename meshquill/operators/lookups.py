"""Joins of nodes and edges: neighbours, details, histograms, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import radius, variant_text
from ..model import GraphTables
from ..sources.normalise import degrees

G = "graph_id"
MIN_QUERY, MAX_HITS = 3, 20


def by_label() -> list[Column]:
    """Locale-aware label order, ties by index."""
    return [F.collate("label", "UNICODE"), F.col("idx")]


def ids_to_index(tables: GraphTables, ids: DataFrame) -> DataFrame:
    return ids.join(tables.nodes.select(G, "id", "idx"), [G, "id"])


def in_neighbours(tables: GraphTables, idx: int) -> DataFrame:
    """(graph_id, idx, id, label) of distinct sources, by label."""
    near = tables.edges.filter(F.col("dst") == idx).select(G, F.col("src").alias("idx")).distinct()
    return near.join(tables.nodes, [G, "idx"]).select(G, "idx", "id", "label").orderBy(*by_label())


def out_neighbours(tables: GraphTables, idx: int) -> DataFrame:
    near = tables.edges.filter(F.col("src") == idx).select(G, F.col("dst").alias("idx")).distinct()
    return near.join(tables.nodes, [G, "idx"]).select(G, "idx", "id", "label").orderBy(*by_label())


def neighbour_counts(tables: GraphTables) -> DataFrame:
    """(graph_id, idx, n_in, n_out): distinct neighbours; no list is made."""
    return degrees(tables).select(G, "idx", F.col("in_degree").alias("n_in"), F.col("out_degree").alias("n_out"))


def node_detail(tables: GraphTables, node_id: str) -> DataFrame:
    """(graph_id, idx, id, label, type, meta); empty for a stale id."""
    return tables.nodes.filter(F.col("id") == node_id).select(G, "idx", "id", "label", "type", "meta")


def meta_entries(nodes: DataFrame) -> DataFrame:
    """(graph_id, idx, key, value): the fields of object metas as text."""
    fit = nodes.filter(F.coalesce(F.schema_of_variant("meta").startswith("OBJECT"), F.lit(False))).select(G, "idx", "meta")
    rows = nodes.sparkSession.sql("SELECT graph_id, idx, m.key, m.value FROM {fit}, LATERAL variant_explode(meta) m", fit=fit)
    return rows.select(G, "idx", "key", variant_text(F.col("value")).alias("value"))


def labels_of(tables: GraphTables, ids: DataFrame) -> DataFrame:
    """(graph_id, id, label) with unknown ids as their own labels, by label."""
    return ids.join(tables.nodes.select(G, "id", "label"), [G, "id"], "left").select(G, "id", F.coalesce("label", "id").alias("label")).orderBy(F.collate("label", "UNICODE"), "id")


def cross_community(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with ``cross``: whether their ends are in different communities."""
    c = lambda end: communities.select(G, F.col("idx").alias(end), F.col("community").alias(f"c_{end}"))
    return edges.join(c("src"), [G, "src"]).join(c("dst"), [G, "dst"]).withColumn("cross", F.col("c_src") != F.col("c_dst")).drop("c_src", "c_dst")


def incidence(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, other, eidx, direction): every edge at both ends."""
    return edges.select(G, F.col("src").alias("idx"), F.col("dst").alias("other"), "eidx", F.lit("out").alias("direction")).unionByName(edges.select(G, F.col("dst").alias("idx"), F.col("src").alias("other"), "eidx", F.lit("in").alias("direction")))


def graph_counts(tables: GraphTables) -> DataFrame:
    n = tables.nodes.groupBy(G).agg(F.count("*").alias("n_nodes"))
    return n.join(tables.edges.groupBy(G).agg(F.count("*").alias("n_edges")), G, "left").select(G, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def type_histogram(rows: DataFrame, types: DataFrame, hidden: frozenset[int]) -> DataFrame:
    """(graph_id, type_id, name, n, hidden): used types, "" shown as untyped;
    nothing for graphs with fewer than two type names."""
    many = types.groupBy(G).agg(F.count("*").alias("k")).filter("k >= 2").select(G)
    named = rows.groupBy(G, "type_id").agg(F.count("*").alias("n")).join(F.broadcast(types), [G, "type_id"]).join(F.broadcast(many), G)
    return named.select(G, "type_id", F.when(F.col("name") == "", "untyped").otherwise(F.col("name")).alias("name"), "n", (F.col("type_id").isin(*hidden) if hidden else F.lit(False)).alias("hidden"))


def radii(tables: GraphTables) -> DataFrame:
    return degrees(tables).select(G, "idx", radius(F.col("in_degree"), F.col("out_degree")).alias("radius"))


def search(tables: GraphTables, query: str, limit: int = MAX_HITS) -> DataFrame:
    """(graph_id, idx, id, label, bucket): the first hits of at least three
    letters in ids or labels; those at the start (bucket 0) come first."""
    q = query.strip().lower()
    if len(q) < MIN_QUERY:
        return tables.nodes.limit(0).select(G, "idx", "id", "label", F.lit(0).alias("bucket"))
    hit = lambda test: test(F.lower("id")) | test(F.lower("label"))
    bucket = F.when(hit(lambda c: c.startswith(q)), 0).when(hit(lambda c: c.contains(q)), 1)
    found = tables.nodes.select(G, "idx", "id", "label", bucket.alias("bucket")).filter("bucket is not null")
    rank = F.row_number().over(Window.partitionBy(G).orderBy("bucket", "idx"))
    return found.withColumn("k", rank).filter(F.col("k") <= limit).drop("k")


def search_hint(query: str, n_hits: int) -> str:
    q = query.strip()
    if not q:
        return ""
    if len(q) < MIN_QUERY:
        return f"type {MIN_QUERY - len(q)} more"
    return "no match" if not n_hits else ""
