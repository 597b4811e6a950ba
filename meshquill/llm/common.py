"""Shared plumbing of the training-data operators: tables, scratch space, sizes.

Scratch tables go below the folder that the session names in
``spark.checkpoint.dir``; a local default is set only where it is unset.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

__all__ = ["drop_scratch", "fresh", "held_out_col", "let", "n_tasks", "read_table", "scratch", "sent_rows", "shared_dir", "ship", "stored", "text_bytes", "words_col"]

#: Separators of a word: space and U+0009 to U+000D.
SPACES = "[ \\t-\\r]"
_written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(_clean, spark)
    path = f"{shared_dir(spark)}/meshquill-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _clean(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone: its folder is the cluster's to clean
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts
    lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch files df reads (a loop's superseded round)."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/meshquill-" in f:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_col(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart
    from df's columns (names are compared without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def held_out_col(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@contextmanager
def sent_rows(spark: SparkSession, rows: int):
    """While it lasts, what is written or collected goes to Python in Arrow
    batches of so many rows at most: fewer bytes at once there and in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows) if int(before) <= 0 else str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
