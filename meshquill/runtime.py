"""Loop and numbering helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 200


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="meshquill-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def settle(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in spark.checkpoint.dir
    (a local default only in local mode, where that is unset)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="meshquill-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str, first: int | Column = 0) -> DataFrame:
    """df with dense numbers in the given total order: a range partitioning,
    numbers inside partitions, and one offset a partition; never one task."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, before = 0, []
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    offsets = spark.createDataFrame(before or [(-1, 0)], "_part int, _before long")
    base = F.lit(first) if isinstance(first, int) else first
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before") + base).drop("_part", "_at", "_before")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
