"""Bounded, deterministic samples of labelled rows, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_col


def bounded_ids(labelled: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of least id hash, as a local table of (doc_id, ...).

    ``limit`` is the documented bound of every fit; rows with a null id, and
    held-out rows, never take part.
    """
    usable = labelled.filter(F.col("doc_id").isNotNull() & ~held_out_col(F.col("doc_id")))
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return labelled.sparkSession.createDataFrame(rows, usable.schema)


def with_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, ...) of the sampled ids; only the sample is broadcast."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(ids), "doc_id")


def one_label(labels: DataFrame, id_col: str, label: Column) -> DataFrame:
    """(doc_id, y) with one 0/1 label an id: the majority, 1 on a tie; nulls do not count."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), label.cast("double").alias("y")).filter("doc_id is not null and y is not null")
    return own.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
