"""Seeded synthetic graphs, made by hashing ranges: any size, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphTables
from .normalise import normalise

#: Lengths of the cycles injected between packages.
CYCLES = (2, 2, 3, 3, 4, 4, 6, 10, 15)


def _pick(n: int | Column, seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n) if isinstance(n, int) else n)


def _raw(graph_id: str, nodes: DataFrame, links: DataFrame) -> GraphTables:
    nodes = nodes.select(F.lit(graph_id).alias("graph_id"), F.col("pos").cast("long"), "id", F.lit(None).cast("string").alias("label"), "type", F.lit(None).cast("variant").alias("meta"))
    return normalise(nodes, links.select(F.lit(graph_id).alias("graph_id"), F.col("pos").cast("long"), F.col("epos").cast("long"), "target", "type"))


def monorepo(spark: SparkSession, packages: int = 100, files: int = 100, layers: int = 10, imports: int = 2, seed: int = 1) -> GraphTables:
    """Packages in layers, each with files; files import from their own package
    and from lower layers; cycles of known lengths run through packages."""
    pkg = lambda p: F.concat(F.lit("@org/p"), p.cast("string"))
    file = lambda p, f: F.concat(pkg(p), F.lit("/f"), f.cast("string"))
    each = spark.range(packages * (files + 1)).select((F.col("id") / (files + 1)).cast("long").alias("p"), (F.col("id") % (files + 1)).alias("f"), F.col("id").alias("pos"))
    nodes = each.select("pos", F.when(F.col("f") == 0, pkg(F.col("p"))).otherwise(file(F.col("p"), F.col("f"))).alias("id"), F.when(F.col("f") == 0, "package").otherwise("file").alias("type"))
    owns = each.filter("f > 0").select((F.col("p") * (files + 1)).alias("pos"), F.col("f").alias("epos"), file(F.col("p"), F.col("f")).alias("target"), F.lit("").alias("type"))
    k = F.explode(F.sequence(F.lit(1), F.lit(imports)))
    inner = each.filter("f > 0").select("p", "f", "pos", k.alias("k"))
    # only to later files of the package, and to packages of lower layers: no cycle by chance
    own = inner.filter(F.col("f") < files).select("pos", F.col("k").alias("epos"), file(F.col("p"), F.col("f") + 1 + _pick(files - F.col("f"), seed, F.col("pos"), F.col("k"))).alias("target"), F.lit("imports").alias("type"))
    width = max(1, packages // layers)
    lower = (F.col("p") / width).cast("long") * width
    down = inner.filter(lower > 0).select("pos", (F.col("k") + imports).alias("epos"), file(_pick(lower, seed + 1, F.col("pos"), F.col("k")), 1 + _pick(files, seed + 2, F.col("pos"), F.col("k"))).alias("target"), F.lit("imports").alias("type"))
    rows, at = [], 0
    for length in CYCLES:
        ring = [(at + i) % packages for i in range(length)]
        rows += [(ring[i], ring[(i + 1) % length], length) for i in range(length)]
        at += length
    ring = spark.createDataFrame(rows, "a long, b long, n int")
    closing = ring.select((F.col("a") * (files + 1) + files).alias("pos"), (F.lit(1000) + F.col("n")).alias("epos"), file(F.col("b"), F.lit(files)).alias("target"), F.lit("cycle").alias("type"))
    return _raw("monorepo", nodes, owns.unionByName(own).unionByName(down).unionByName(closing))


def clustered(spark: SparkSession, n: int = 1000, intra: int = 4, inter: float = 0.04, seed: int = 1) -> GraphTables:
    """About sqrt(n) communities of random links, and few links between."""
    k = max(1, round(n**0.5))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = spark.range(n).select(F.col("id").alias("pos"), name(F.col("id")).alias("id"), F.concat(F.lit("c"), (F.col("id") % k).cast("string")).alias("type"))
    each = spark.range(n).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(1), F.lit(intra + 1))).alias("epos"))
    mate = _pick(max(1, n // k), seed, F.col("pos"), F.col("epos")) * k + F.col("pos") % k
    far = _pick(n, seed + 1, F.col("pos"), F.col("epos"))
    chance = _pick(1_000_000, seed + 2, F.col("pos")) < int(inter * 1_000_000)
    links = each.filter((F.col("epos") <= intra) | chance).select("pos", "epos", name(F.when(F.col("epos") <= intra, mate).otherwise(far)).alias("target"), F.lit("").alias("type"))
    return _raw("clustered", nodes, links)


def hub(spark: SparkSession, packages: int = 100, hub_files: int = 1000, cycles: int = 100, length: int = 4, touching: int | None = None, seed: int = 1) -> GraphTables:
    """A hub package with many files, and cycles through packages; all of them,
    or only ``touching`` ones, run through the hub (package 0)."""
    touching = cycles if touching is None else touching
    pkg = lambda p: F.concat(F.lit("p"), p.cast("string"))
    nodes = spark.range(packages).select(F.col("id").alias("pos"), pkg(F.col("id")).alias("id"), F.lit("package").alias("type"))
    nodes = nodes.unionByName(spark.range(hub_files).select((F.col("id") + packages).alias("pos"), F.concat(F.lit("p0/f"), F.col("id").cast("string")).alias("id"), F.lit("file").alias("type")))
    owns = spark.range(hub_files).select(F.lit(0).alias("pos"), F.col("id").alias("epos"), F.concat(F.lit("p0/f"), F.col("id").cast("string")).alias("target"), F.lit("").alias("type"))
    step = spark.range(cycles * length).select((F.col("id") / length).cast("long").alias("c"), (F.col("id") % length).alias("i"))
    # the places of a cycle are distinct: a stride through the other packages
    place = lambda i: F.when((i == 0) & (F.col("c") < touching), 0).otherwise(1 + F.pmod(_pick(packages - 1, seed, F.col("c")) + i * (1 + (packages - 2) // length), F.lit(packages - 1)))
    links = step.select(place(F.col("i")).alias("pos"), (F.col("c") + hub_files).alias("epos"), pkg(place((F.col("i") + 1) % length)).alias("target"), F.lit("depends").alias("type"))
    return _raw("hub", nodes, owns.unionByName(links))
