"""A training corpus from `documents`, in five stages; each stage's Parquet output is the next one's docs."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import decontamination, packing, quality_rules, secret_scan, simhash
from strandweave.llm.common import discard, materialize, table

SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows that repeat its id and text, one. Rows with the same id and other texts are judged on their own. Rows without an id stay."""
    groups = simhash.copy_groups(docs, SHINGLE_WORDS)
    groups = materialize(groups.groupBy("id", "name", "group").agg(F.count(F.lit(1)).alias("rows")), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("id", "name")).alias("first")).select("group", "first")
    judged = groups.join(first.hint("merge"), "group").select(F.col("id").alias("strandweave_id"), F.col("name").alias("strandweave_name"), "rows", (F.struct("id", "name") == F.col("first")).alias("stays"))
    judged = materialize(judged.where("not stays or rows > 1"), "copies")
    discard(groups)
    own = docs.withColumns({"strandweave_id": F.col("doc_id").cast("long"), "strandweave_name": F.xxhash64(F.col("text").cast("string"))})
    at = ["strandweave_id", "strandweave_name"]
    kept = own.join(judged.select(at).hint("merge"), at, "left_anti")
    repeated = judged.where("stays").select(at)
    if not repeated.isEmpty():
        kept = kept.unionByName(own.join(repeated.hint("merge"), at, "left_semi").dropDuplicates(at))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact(docs, secret_scan.fit())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination_stage), ("secret_scan", secrets), ("packing", pack)]

#: Trained trees, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
