"""SimHash near-dedup over a Gray-order hierarchical index.

Two fingerprints that differ in at most two bits agree on one of three bit
blocks. Distinct fingerprints are dealt by (block, bits of the block) to
buckets; a block value that very many fingerprints share is dealt further by
three blocks of the remaining bits, which again loses no pair. Each bucket is
one Gray-order index and returns, for every fingerprint that has a link, its
root in the bucket: never all pairs. Components of these stars are joined by
alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesvec import as_array
from .common import drop_scratch, fresh, n_tasks, ship, stored
from .graycode import GrayIndex, components

SHINGLE, LIMIT = 3, 2
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one block value beyond which it is dealt further; of one bucket.
HOT, PER_BUCKET = 20_000, 50_000
_M64 = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as a signed long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(g, 42) for g in grams), np.uint64)
    ones, n = np.zeros(64, np.int64), len(h)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def scan(batches):
        for b in batches:
            fp = [fingerprint(t.as_py()) for t in as_array(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(scan, "doc_id long, fp long")


def _bits(fp: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << n) - 1)


def _thirds(start: int, n: int) -> list[list[tuple[int, int]]]:
    """The bits outside (start, n) as three groups of (start, length) pieces."""
    rest = [i for i in range(64) if not start <= i < start + n]
    size, out = -(-len(rest) // 3), []
    for k in range(0, len(rest), size):
        pieces: list[list[int]] = []
        for bit in rest[k : k + size]:
            if pieces and pieces[-1][0] + pieces[-1][1] == bit:
                pieces[-1][1] += 1
            else:
                pieces.append([bit, 1])
        out.append([tuple(p) for p in pieces])
    return out


def links(fps: DataFrame, limit: int = LIMIT, hot: int = HOT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(fp, root): star edges that join all distinct fps within limit bits.

    limit may be at most 2 (three blocks).
    """
    if limit > len(BLOCKS) - 1:
        raise ValueError("three blocks find links of two differing bits at most")
    spark = fps.sparkSession
    ship(spark)
    buckets = max(n_tasks(spark), -(-3 * fps.count() // per_bucket))
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("blk"), _bits(F.col("fp"), s, n).alias("val")) for b, (s, n) in enumerate(BLOCKS)])).alias("k")).select("fp", "k.*")
    crowded = keys.groupBy("blk", "val").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("blk", "val", F.lit(True).alias("is_hot"))
    keys = keys.join(crowded, ["blk", "val"], "left")
    deeper = F.lit(None)
    for b, (s, n) in enumerate(BLOCKS):
        subs = [F.concat_ws(":", F.lit(k), *[_bits(F.col("fp"), *p) for p in pieces]) for k, pieces in enumerate(_thirds(s, n))]
        deeper = F.when(F.col("blk") == b, F.array(*subs)).otherwise(deeper)
    keys = keys.withColumn("sub", F.explode(F.when(F.col("is_hot"), deeper).otherwise(F.array(F.lit("")))))
    keys = keys.select("fp", "blk", F.pmod(F.xxhash64("blk", "val", "sub"), F.lit(buckets)).alias("bucket"))

    def star(table: pa.Table) -> pa.Table:
        fp = np.unique(table["fp"].to_numpy().view(np.uint64))
        turn = np.uint64((BLOCKS[table["blk"][0].as_py()][0] + BLOCKS[table["blk"][0].as_py()][1]) % 64)
        turned = (fp >> turn) | (fp << np.uint64((64 - int(turn)) % 64)) if turn else fp  # the block's bits first
        index = GrayIndex(turned)
        root = components(len(fp), index.pairs(limit))
        v = index.values
        v = (v << turn) | (v >> np.uint64((64 - int(turn)) % 64)) if turn else v
        linked = root != np.arange(len(root))
        return pa.table({"fp": v[linked].view(np.int64), "root": v[root[linked]].view(np.int64)})

    return keys.groupBy("blk", "bucket").applyInArrow(star, "fp long, root long")


def join_stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(fp, root) with one root for each component, from any (fp, root) edges:
    alternating large-star and small-star until nothing changes."""

    def settle(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = stored(e.filter("u <> v").distinct(), "star")
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.when(F.col("v") < F.col("u"), 1).otherwise(0))).first()
        return e, tuple(row)

    e, now = settle(edges.select(F.greatest("fp", "root").alias("u"), F.least("fp", "root").alias("v")))
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = e.join(low, F.col("v") == F.col("c")).select("u", F.col("m").alias("v"))
        large, _seen = settle(large.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new, then = settle(small.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))))
        drop_scratch(e)
        drop_scratch(large)
        e, same, now = new, then == now, then
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Near-duplicate classes: ``doc_id, fp, fingerprint, component_id``.

    Texts are lower-cased (A-Z) and shingled by three words; fingerprints link
    at ``limit`` differing bits or fewer; component_id is the smallest id that
    can be reached.

    Null and empty texts have fingerprint zero, which links like any other. A
    null id takes part but is never a component_id unless its class has no
    other id (then null). Rows that share an id each give a row. Other columns
    are ignored, whatever their names.
    """
    prints = stored(with_fingerprints(docs, id_col, text_col), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = join_stars(stored(links(distinct.select("fp"), limit, hot, per_bucket), "links"))
    member = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = stored(member.join(lowest, "root").select("fp", "component_id"), "member")
    return prints.join(member, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id. Rows that
    share the kept id all stay, as do rows with a null id."""
    found = near_duplicates(docs, limit, id_col, text_col)
    (name,) = fresh(docs, "gone")
    gone = stored(found.filter("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
