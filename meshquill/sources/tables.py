"""Graphs over ordinary tables. Indices are sparse but keep the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GraphTables
from ..runtime import settle
from .normalise import interned, normalise

STEP = 1 << 40
# Table, key and label columns of each node type, in index order.
PURCHASE = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", None))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, (table, key, label) in enumerate(PURCHASE):
        id_ = F.concat(F.lit(f"{table}/"), F.col(key).cast("string"))
        part = read(spark, sf_dir, table).select(F.lit("purchase").alias("graph_id"), (F.lit(k * STEP) + F.col(key).cast("long")).alias("idx"), id_.alias("id"), (F.col(label) if label else id_).alias("label"), F.lit(k + 1).alias("type_id"), F.lit(table).alias("type"), F.lit(None).cast("variant").alias("meta"), F.lit(True).alias("declared"))
        out = part if out is None else out.unionByName(part)
    return out


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contain: region, nation, customer or supplier; places: customer, order;
    item: order, part; supplies: supplier, part."""
    t = lambda n: read(spark, sf_dir, n)
    at = {name: k for k, (name, _, _) in enumerate(PURCHASE)}
    idx = lambda name, c: (F.lit(at[name] * STEP) + F.col(c).cast("long"))
    parts = [
        (t("nation"), idx("region", "n_regionkey"), idx("nation", "n_nationkey"), 1, "contain"),
        (t("customer"), idx("nation", "c_nationkey"), idx("customer", "c_custkey"), 1, "contain"),
        (t("supplier"), idx("nation", "s_nationkey"), idx("supplier", "s_suppkey"), 1, "contain"),
        (t("orders"), idx("customer", "o_custkey"), idx("orders", "o_orderkey"), 2, "places"),
        (t("lineitem"), idx("orders", "l_orderkey"), idx("part", "l_partkey"), 3, "item"),
        (t("lineitem"), idx("supplier", "l_suppkey"), idx("part", "l_partkey"), 4, "supplies"),
    ]
    out = None
    for df, s, d, k, name in parts:
        part = df.select(s.alias("src"), d.alias("dst"), F.lit(k).alias("type_id"), F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return settle(out.distinct())


def purchase_graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """The typed purchase graph. An edge's index is a pure function of its
    ends, so no numbering pass is needed; it orders edges by source and target."""
    edges = purchase_edges(spark, sf_dir).select(F.lit("purchase").alias("graph_id"), (F.col("src") * 1).alias("src"), "dst", "type_id", "type")
    edges = edges.select("graph_id", F.struct("src", "dst").alias("eidx"), "src", "dst", "type_id", "type")
    names = lambda rows: spark.createDataFrame([("purchase", i, n) for i, n in enumerate(rows)], "graph_id string, type_id int, name string")
    return GraphTables(purchase_nodes(spark, sf_dir), edges, names(["", *[p[0] for p in PURCHASE], "missing"]), names(["", "contain", "places", "item", "supplies"]))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, event_type, at): user to next user on the same day by time, of
    all events. They are dealt by day without a column of it and in the order of
    each input part, as rows so alike take less than half of the disk."""
    day = Window.partitionBy("day").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), "event_type", "ts", "event_id")
    dealt = events.sortWithinPartitions("ts", "event_id").repartition(F.to_date("ts")).withColumn("day", F.to_date("ts"))
    out = dealt.select("src", F.lead("src").over(day).alias("dst"), "event_type", F.struct("ts", "event_id").alias("at"))
    return out.filter("dst is not null and src <> dst")


def _users(spark: SparkSession, sf_dir: str, name: str, links: DataFrame, kinds: list[str], kind: Column) -> GraphTables:
    """A graph of users; a node's index is its user id, its type one of kinds."""
    links = settle(links.groupBy("src", "dst").agg(F.min_by("event_type", "at").alias("type")).select(F.lit(name).alias("graph_id"), F.struct("src", "dst").alias("eidx"), "src", "dst", "type"))
    types = settle(interned(links.select("graph_id", F.col("type").alias("name"), F.col("type").alias("at")), "edge"))
    edges = links.join(F.broadcast(types.withColumnRenamed("name", "type")), ["graph_id", "type"]).select("graph_id", "eidx", "src", "dst", "type_id", "type")
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("idx")).distinct().withColumn("type_id", kind)
    names = ["", *kinds, "missing"]
    nodes = users.select(F.lit(name).alias("graph_id"), "idx", F.concat(F.lit("user/"), F.col("idx").cast("string")).alias("id"), F.concat(F.lit("User "), F.col("idx").cast("string")).alias("label"), "type_id", F.get(F.array(*map(F.lit, names)), F.col("type_id")).alias("type"), F.lit(None).cast("variant").alias("meta"), F.lit(True).alias("declared"))
    node_types = spark.createDataFrame([(name, i, n) for i, n in enumerate(names)], "graph_id string, type_id int, name string")
    return GraphTables(nodes, edges, node_types, types)


def handoff_graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """All hand-offs of a user to the next one of the day: dense in cycles; the
    first of parallel ones gives the type."""
    return _users(spark, sf_dir, "handoff", steps(spark, sf_dir), ["user"], F.lit(1))


def contact_graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Each user's first and last hand-off over all events: sparse, with long
    cycles and with users that no cycle reaches. Every 25th user is an agent,
    the others are clients."""
    ends = steps(spark, sf_dir).groupBy("src").agg(F.min(F.struct("at", "dst", "event_type")).alias("a"), F.max(F.struct("at", "dst", "event_type")).alias("z"))
    links = ends.select("src", F.explode(F.array("a", "z")).alias("x")).select("src", "x.dst", "x.event_type", "x.at")
    return _users(spark, sf_dir, "contact", links, ["agent", "client"], F.when(F.col("idx") % 25 == 0, 1).otherwise(2))


def link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw_nodes, raw_links) of the pages and their href targets."""
    pages = read(spark, sf_dir, "pages")
    nodes = pages.select(F.lit("links").alias("graph_id"), F.col("page_id").alias("pos"), F.col("url").alias("id"), F.lit(None).cast("string").alias("label"), F.lit("page").alias("type"), F.lit(None).cast("variant").alias("meta"))
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("epos", "target"))
    return nodes, found.select(F.lit("links").alias("graph_id"), F.col("page_id").alias("pos"), F.col("epos").cast("long"), "target", F.lit("href").alias("type"))


def link_graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    return normalise(*link_tables(spark, sf_dir))
