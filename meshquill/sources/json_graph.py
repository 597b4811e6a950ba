"""Adjacency-list JSON: read, validate, explode; store and restore.

Edges may mix strings, numbers and objects, so documents are parsed as VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphTables, SchemaError
from . import generators
from .normalise import normalise

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, text): one document a file, named by its file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.json)?$", 1).alias("graph_id"), F.col("value").alias("text"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_id(v: Column) -> Column:
    return (_kind(v) == "STRING") | _kind(v).rlike(_NUMBER)


def id_text(v: Column) -> Column:
    """Numbers as JavaScript writes them: no fraction of whole ones, and
    exponents as e+21."""
    text = F.regexp_replace(F.try_variant_get(v, "$", "string"), "(?:\\.0)?E(-?)(\\d)", "e$1$2")
    shown = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.regexp_replace(text, "e(\\d)", "e+$1"))
    return F.when(_is_id(v), shown)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parsed(documents: DataFrame) -> DataFrame:
    return documents.select("graph_id", F.try_parse_json("text").alias("doc"))


def _nodes(docs: DataFrame) -> DataFrame:
    good = docs.filter(F.coalesce(_kind(_get(F.col("doc"), "$.nodes")).startswith("ARRAY"), F.lit(False))).select("graph_id", _get(F.col("doc"), "$.nodes").alias("nodes"))
    return docs.sparkSession.sql("SELECT graph_id, n.pos, n.value AS node FROM {good}, LATERAL variant_explode(nodes) n", good=good)


def _edges(nodes: DataFrame) -> DataFrame:
    lists = nodes.select("graph_id", "pos", _get(F.col("node"), "$.edges").alias("edges")).filter(F.coalesce(_kind(F.col("edges")).startswith("ARRAY"), F.lit(False)))
    return nodes.sparkSession.sql("SELECT graph_id, l.pos, e.pos AS epos, e.value AS edge FROM {lists} l, LATERAL variant_explode(edges) e", lists=lists)


def violations(documents: DataFrame) -> DataFrame:
    """(graph_id, at, message) of everything that is no graph; ``at`` orders
    by node and edge."""
    docs = parsed(documents)
    doc, node, edge = F.col("doc"), F.col("node"), F.col("edge")
    none = F.lit(None).cast("string")
    top = F.when(doc.isNull(), "Invalid JSON").when(~_kind(doc).startswith("OBJECT"), "the document must be an object").when(~F.coalesce(_kind(_get(doc, "$.nodes")).startswith("ARRAY"), F.lit(False)), "nodes must be an array").otherwise(none)
    spot = lambda *c: F.concat(F.lit("nodes["), c[0], F.lit("]"), *([F.lit(".edges["), c[1], F.lit("]")] if len(c) > 1 else []))
    text_or_absent = lambda v: v.isNull() | (_kind(v) == "STRING")
    nodes = _nodes(docs)
    said = F.when(~_kind(node).startswith("OBJECT"), " must be an object").when(~F.coalesce(_is_id(_get(node, "$.id")), F.lit(False)), ".id must be a string or number").when(~text_or_absent(_get(node, "$.label")), ".label must be a string").when(~text_or_absent(_get(node, "$.type")), ".type must be a string").when(_get(node, "$.edges").isNotNull() & ~_kind(_get(node, "$.edges")).startswith("ARRAY"), ".edges must be an array").otherwise(none)
    target = _get(edge, "$.nodeId")
    link = F.when(_is_id(edge), none).when(~_kind(edge).startswith("OBJECT"), " must be a string, number or object").when(~F.coalesce(_is_id(target), F.lit(False)), ".nodeId must be a string or number").when(F.coalesce(_kind(_get(edge, "$.edgeType")) != "STRING", F.lit(True)), ".edgeType must be a string").otherwise(none)
    rows = docs.select("graph_id", F.array(F.lit(-1), F.lit(-1)).alias("at"), top.alias("message"))
    rows = rows.unionByName(nodes.select("graph_id", F.array(F.col("pos"), F.lit(-1)).alias("at"), F.concat(spot(F.col("pos")), said).alias("message")))
    rows = rows.unionByName(_edges(nodes).select("graph_id", F.array("pos", "epos").alias("at"), F.concat(spot(F.col("pos"), F.col("epos")), link).alias("message")))
    ids = nodes.select("graph_id", "pos", id_text(_get(node, "$.id")).alias("id")).filter("id is not null")
    twice = ids.groupBy("graph_id", "id").agg(F.count("*").alias("n"), F.max("pos").alias("pos")).filter("n > 1")
    rows = rows.unionByName(twice.select("graph_id", F.array(F.col("pos"), F.lit(-1)).alias("at"), F.concat(F.lit("duplicate node id "), "id").alias("message")))
    return rows.filter("message is not null")


def first_violations(documents: DataFrame) -> DataFrame:
    return violations(documents).groupBy("graph_id").agg(F.min_by("message", "at").alias("message"))


def raw_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_nodes, raw_links) of valid documents."""
    nodes = _nodes(parsed(documents))
    node, edge = F.col("node"), F.col("edge")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    raw_nodes = nodes.select("graph_id", F.col("pos").cast("long"), id_text(_get(node, "$.id")).alias("id"), text(node, "$.label").alias("label"), text(node, "$.type").alias("type"), _get(node, "$.meta").alias("meta"))
    links = _edges(nodes).select("graph_id", F.col("pos").cast("long"), F.col("epos").cast("long"), F.coalesce(id_text(edge), id_text(_get(edge, "$.nodeId"))).alias("target"), F.when(_kind(edge).startswith("OBJECT"), text(edge, "$.edgeType")).otherwise("").alias("type"))
    return raw_nodes, links


def load_graphs(documents: DataFrame) -> GraphTables:
    """The tables of (graph_id, text) documents; a SchemaError names the first
    offence of the first bad document."""
    bad = first_violations(documents).orderBy("graph_id").first()
    if bad:
        raise SchemaError(f"{bad['graph_id']}: {bad['message']}")
    return normalise(*raw_tables(documents))


def load_graph(spark: SparkSession, path: str) -> GraphTables:
    return load_graphs(read_documents(spark, path))


#: Named datasets: name to the path of a document, or to a function of the session.
DATASETS: dict[str, str | Callable[[SparkSession], GraphTables]] = {"packages": generators.monorepo, "clusters": generators.clustered, "hub": generators.hub}


def load_named(spark: SparkSession, name: str) -> GraphTables:
    if name not in DATASETS:
        raise SchemaError(f"no dataset is named {name}")
    found = DATASETS[name]
    return load_graph(spark, found) if isinstance(found, str) else found(spark)


def persist(documents: DataFrame, path: str) -> bool:
    """Keep raw documents; a failure is not fatal."""
    try:
        documents.select("graph_id", "text").write.mode("overwrite").parquet(path)
        return True
    except Exception:
        return False


def restore(spark: SparkSession, path: str, loaded: GraphTables | None = None) -> GraphTables | None:
    """The kept graphs; never in the place of those loaded meanwhile."""
    if loaded is not None:
        return loaded
    from pyspark.errors import AnalysisException

    try:
        return load_graphs(spark.read.parquet(path))
    except AnalysisException:
        return None


def clear(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def to_document(tables: GraphTables) -> DataFrame:
    """(graph_id, ids_json, edges_flat): ids by index, and source and target
    of the edges one after the other."""
    ids = tables.nodes.groupBy("graph_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"])).alias("ids_json"), F.count("*").alias("node_count"))
    flat = tables.edges.groupBy("graph_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("eidx", "src", "dst"))), lambda x: F.array(x["src"], x["dst"]))).alias("edges_flat"))
    return ids.join(flat, "graph_id", "left").withColumn("edges_flat", F.coalesce("edges_flat", F.array().cast("array<bigint>")))


def cycle_codec(cycles: DataFrame) -> DataFrame:
    """(graph_id, flat) of (graph_id, seq, cycle): length, nodes, length, ..."""
    return cycles.groupBy("graph_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "cycle"))), lambda x: F.concat(F.array(F.size(x["cycle"]).cast("long")), x["cycle"]))).alias("flat"))
