"""The corpus pipeline: five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm import decontaminate, mixing, quality_rules, simhash
from meshquill.llm.common import fresh, read_table, stored
from meshquill.llm.registry import token_ids


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words
    and go; repeated rows are judged alike; an empty table stays empty."""
    return quality_rules.apply_rules(docs, read_table(spark, sf_dir, "labels"), keep_columns=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each near-duplicate group. Rows with a
    null id stay, as do rows that share the kept id; null and empty texts are
    one group; an empty table stays empty."""
    return simhash.keep_one(docs, limit=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates. Rows with a null id, and
    null and empty texts, stay; rows that share a contaminated one's id go."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), near=0)
    (name,) = fresh(docs, "gone")
    gone = stored(found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rates say. Repeated rows have the same
    rate; null and empty texts have no tokens and rate 1."""
    return mixing.mixed(docs, read_table(spark, sf_dir, "labels"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable codes, written and read back. A null
    text has only the end id; a null id stands first."""
    return token_ids(spark, docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("token_ids", write_token_ids),
]
#: Hashes, iteration and tokenizing cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
