"""The training-data queries, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import chat_quotes, decontamination, oracle, packing, pii, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, toxicity
from strandweave.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), keep_text=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per toxic document."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def _conversations(conversations: DataFrame) -> DataFrame:
    made = chat_quotes.build_conversations(chat_quotes.link_conversations(conversations))
    replies = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["turn"], F.coalesce(m["reply_to"].cast("string"), F.lit("")))), ",")
    return made.select("conv_id", "thread", "part", "n_messages", "n_quotes", "max_level", replies.alias("replies"), F.sha2("chat", 256).alias("chat_sha256"))


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part of a thread in reply order."""
    return _conversations(table(spark, sf_dir, "conversations"))


def chat_quotes_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations whose messages quote each other, which those of the tables don't."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("strandweave_conversations")
    return _conversations(spark.sql("SELECT * FROM " + oracle.MADE_QUOTES.replace("FROM conversations", "FROM strandweave_conversations")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per secret found."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.fit())


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_chat_quotes": op9_chat_quotes,
    "op10_secret_scan": op10_secret_scan,
    "chat_quotes_made": chat_quotes_made,
}

#: The others need a trained model, a seeded hash or a tokenizer; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op3_decontamination": oracle.DECONTAMINATION,
    "op9_chat_quotes": oracle.CHAT_QUOTES,
    "chat_quotes_made": oracle.CHAT_QUOTES_MADE,
}
