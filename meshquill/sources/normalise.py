"""From raw nodes and raw links to the tables of a graph.

raw_nodes: graph_id, pos, id, label, type, meta (variant).
raw_links: graph_id, pos (of the source), epos, target (id), type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MISSING, GraphTables
from ..runtime import settle

G = "graph_id"


def interned(used: DataFrame, kind: str, tail: list[str] = ()) -> DataFrame:
    """(graph_id, type_id, name): "" is 0, names follow by first use (column
    ``at``), then those of ``tail`` that were not used. Few rows a graph."""
    first = used.groupBy(G, "name").agg(F.min("at").alias("at"), F.lit(1).alias("rank"))
    graphs = used.select(G).distinct()
    extra = graphs.select(G, F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("rank")), *[F.struct(F.lit(t).alias("name"), F.lit(2).alias("rank")) for t in tail])).alias("x")).select(G, "x.name", F.lit(None).cast(first.schema["at"].dataType).alias("at"), "x.rank")
    every = first.filter("name <> ''").unionByName(extra.filter("rank = 0")).unionByName(extra.filter("rank = 2").join(first.select(G, "name"), [G, "name"], "left_anti"))
    return every.withColumn("type_id", F.row_number().over(Window.partitionBy(G).orderBy("rank", "at", "name")) - 1).select(G, F.col("type_id").cast("int"), "name")


def placeholders(raw_nodes: DataFrame, raw_links: DataFrame) -> DataFrame:
    """(graph_id, idx, id): a node for each unknown target, after all declared
    nodes, by first reference."""
    known = raw_nodes.select(G, F.col("id").alias("target"))
    unknown = raw_links.join(known, [G, "target"], "left_anti").groupBy(G, "target").agg(F.min(F.struct("pos", "epos")).alias("at"))
    size = raw_nodes.groupBy(G).agg((F.max("pos") + 1).alias("n0"))
    order = F.row_number().over(Window.partitionBy(G).orderBy("at")) - 1
    return unknown.withColumn("k", order).join(size, G).select(G, (F.col("n0") + F.col("k")).cast("long").alias("idx"), F.col("target").alias("id"))


def normalise(raw_nodes: DataFrame, raw_links: DataFrame) -> GraphTables:
    """The tables of the graphs: labels default to ids, unknown targets become
    placeholders of type ``missing``, self-loops go, and of parallel edges the
    first stays. Indices follow the input; edge types are interned by the edges
    that stay."""
    nodes = raw_nodes.select(G, F.col("pos").alias("idx"), "id", F.coalesce("label", "id").alias("label"), F.coalesce("type", F.lit("")).alias("type"), "meta", F.lit(True).alias("declared"))
    made = placeholders(raw_nodes, raw_links).select(G, "idx", "id", F.col("id").alias("label"), F.lit(MISSING).alias("type"), F.lit(None).cast("variant").alias("meta"), F.lit(False).alias("declared"))
    node_types = interned(nodes.select(G, F.col("type").alias("name"), F.col("idx").alias("at")), "node", [MISSING])
    both = nodes.unionByName(made)
    typed = both.join(F.broadcast(node_types.withColumnRenamed("name", "type")), [G, "type"])
    typed = settle(typed.select(G, "idx", "id", "label", "type_id", "type", "meta", "declared"))

    ends = typed.select(G, F.col("id").alias("target"), F.col("idx").alias("dst"))
    links = raw_links.join(ends, [G, "target"]).filter("pos <> dst")
    first = links.groupBy(G, F.col("pos").alias("src"), "dst").agg(F.min_by(F.coalesce("type", F.lit("")), "epos").alias("type"), F.min("epos").alias("epos"))
    edge_types = interned(first.select(G, F.col("type").alias("name"), F.struct("src", "epos").alias("at")), "edge")
    per_source = first.groupBy(G, "src").agg(F.count("*").alias("n"))
    before = per_source.withColumn("before", F.sum("n").over(Window.partitionBy(G).orderBy("src").rowsBetween(Window.unboundedPreceding, -1))).select(G, "src", F.coalesce("before", F.lit(0)).alias("before"))
    placed = first.withColumn("k", F.row_number().over(Window.partitionBy(G, "src").orderBy("epos")) - 1).join(before, [G, "src"])
    edges = placed.join(F.broadcast(edge_types.withColumnRenamed("name", "type")), [G, "type"]).select(G, (F.col("before") + F.col("k")).cast("long").alias("eidx"), "src", "dst", "type_id", "type")
    return GraphTables(typed, settle(edges), node_types, edge_types)


def diagnostics(raw_nodes: DataFrame, raw_links: DataFrame) -> DataFrame:
    """(graph_id, created_missing, edges_to_missing, dropped_self): every raw
    link to a placeholder counts."""
    known = raw_nodes.select(G, F.col("id").alias("target"), F.col("pos").alias("at"))
    links = raw_links.join(known, [G, "target"], "left")
    return links.groupBy(G).agg(
        F.countDistinct(F.when(F.col("at").isNull(), F.col("target"))).alias("created_missing"),
        F.count(F.when(F.col("at").isNull(), 1)).alias("edges_to_missing"),
        F.count(F.when(F.col("at") == F.col("pos"), 1)).alias("dropped_self"),
    )


def degrees(tables: GraphTables) -> DataFrame:
    """(graph_id, idx, in_degree, out_degree) of every node."""
    ends = tables.edges.select(G, F.col("src").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(tables.edges.select(G, F.col("dst").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy(G, "idx").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return tables.nodes.select(G, "idx").join(counted, [G, "idx"], "left").select(G, "idx", zero("in_degree"), zero("out_degree"))
