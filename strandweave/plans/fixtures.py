"""Sequences and reads made of ordinary tables, alike in Spark and in SQL.

Documents serve as reference sequences. Every benchmark item is a read, and
so is every item followed by the reverse complement of the next one: a read
whose halves lie on different strands, and mostly on different sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.sequences import letters_as_bases, reverse_complement
from strandweave.session import ship

FIRST_JOINED = 1_000_000

_ENC = "translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"

#: WITH clauses for the oracle: seqs(seq_id, seq), reads(query_id, seq), stranded(query_id, strand, seq).
SEQS_SQL = f"seqs AS (SELECT doc_id AS seq_id, {_ENC} AS seq FROM documents)"
READS_SQL = f"""items AS (SELECT item_id, {_ENC} AS seq FROM benchmark),
reads AS (SELECT item_id AS query_id, seq FROM items
  UNION ALL SELECT {FIRST_JOINED} + item_id, seq || {_RC.format("nxt")} FROM (SELECT item_id, seq, lead(seq) OVER (ORDER BY item_id) AS nxt FROM items) WHERE nxt IS NOT NULL),
stranded AS (SELECT query_id, '+' AS strand, seq FROM reads UNION ALL SELECT query_id, '-', {_RC.format("seq")} FROM reads)"""


def pack_sql(kmer: str, word_len: int = 15) -> str:
    """The number of an ACGT-only k-mer in SQL."""
    return "(" + " + ".join(f"CAST(instr('TCAG', substr({kmer}, {i + 1}, 1)) - 1 AS BIGINT) * {4 ** (word_len - 1 - i)}" for i in range(word_len)) + ")"


def kmers_sql(word_len: int = 15, skip: int = 1) -> str:
    """kmers(seq_id, pos, kmer) over seqs, which are ACGT-only."""
    return f"""kmer_text AS (SELECT seq_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), {word_len}) AS k FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {word_len - 1}, {skip})) AS pos FROM seqs)),
kmers AS (SELECT seq_id, CAST(pos AS INTEGER) AS pos, {pack_sql("k", word_len)} AS kmer FROM kmer_text)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("doc"), "doc_id").alias("name"), letters_as_bases(F.coalesce("text", F.lit(""))).alias("seq"))


#: Letters as bases and, for four of them, N; letters as all codes that a sequence may hold.
_LETTERS, _WITH_N, _IUPAC = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTANGTACGTNCGTACGNAN", "ACGTRYMKVBDHSWNXACGTRYMKVB"
_MAPPED = "translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '" + _LETTERS + "', '{}')"
WITH_N_SQL, IUPAC_SQL = _MAPPED.format(_WITH_N), _MAPPED.format(_IUPAC)


def _mapped(text: Column, to: str) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), _LETTERS, to)


def letters_as_iupac(text: Column) -> Column:
    return _mapped(text, _IUPAC)


def sequences_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), _mapped(F.coalesce("text", F.lit("")), _WITH_N).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window over all items orders a benchmark, whose size doesn't follow the corpus."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", letters_as_bases(F.coalesce("text", F.lit(""))).alias("seq"))
    after = items.withColumn("_next", F.lead("seq").over(Window.orderBy("item_id"))).where("_next is not null")
    split = after.select((F.lit(FIRST_JOINED) + F.col("item_id")).alias("query_id"), F.concat("seq", reverse_complement(F.col("_next"))).alias("seq"))
    both = items.select(F.col("item_id").alias("query_id"), "seq").unionByName(split)
    return both.select("query_id", F.concat(F.lit("read"), "query_id").alias("qname"), "seq", F.lit(None).cast("string").alias("qual"))
