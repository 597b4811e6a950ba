"""Edges as a stream: first of parallel edges, self-loops dropped, degrees.

Each micro-batch is merged into tables that the next one reads; a batch that is
run again after a failure changes nothing, as its version is already there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDGES = "graph_id string, src long, dst long, type string, batch long"
KEY = ["graph_id", "src", "dst"]


def new_edges(batch: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """Edges of a batch that earlier batches do not have; the first by ``at``
    gives the type."""
    first = batch.filter("src <> dst").groupBy(*KEY).agg(F.min_by("type", "at").alias("type"))
    return first.join(known.filter(F.col("batch") < number), KEY, "left_anti").select(*KEY, "type", F.lit(number).cast("long").alias("batch"))


def edge_stream(links: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the new edges of a stream (graph_id, src, dst, type, at) below
    path, a folder a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        known = stored_edges(batch.sparkSession, path)
        new_edges(batch, known, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = links.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_edges(spark: SparkSession, path: str) -> DataFrame:
    """All edges so far (an empty table before the first batch)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(EDGES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], EDGES)


def degree_table(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, in_degree, out_degree) of the nodes that have edges."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("idx"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("idx"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("graph_id", "x.idx").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def handoff_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events a user and window, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"))
