"""FASTA and FASTQ files as DataFrames.

Files are read by Spark's text source, so that any store it reaches will do
and large files are split. Records are numbered in file order from the counts
per file split, not by a sort of all lines.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.sequences import normalise, query_name
from strandweave.params import AlignParams
from strandweave.session import ship


def numbered(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, n, value): the separated pieces of each file, numbered from 0 in file order."""
    raw = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    blocks = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return raw.join(blocks, ["file", "_block"]).select("file", (F.col("_base") + F.col("_id") - F.col("_first")).alias("n"), "value")


def _ids(pieces: DataFrame) -> DataFrame:
    """Adds id: a number per record, dense from 0 over the files in order of their paths."""
    sizes = pieces.groupBy("file").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    return pieces.join(base, "file").withColumn("id", F.col("_b") + F.col("n"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, seq) of FASTA files: > starts a sequence, its name ends at the first blank; control characters vanish, other junk becomes X."""
    pieces = numbered(spark, path, ">").where("n > 0").withColumn("n", F.col("n") - 1)
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(value, length(_head) + 2)"), r"[\x00-\x1f]", "")
    return _ids(pieces).withColumn("_head", head).select(F.col("id").alias("seq_id"), F.regexp_extract("_head", r"^([^ \r]*)", 1).alias("name"), normalise(body).alias("seq"))


def read_fasta_reads(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, qname, seq, qual): qual is null."""
    pieces = numbered(spark, path, ">").where("n > 0").withColumn("n", F.col("n") - 1)
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(_head) + 2)"), r"[\r\n]", "")
    told = _ids(pieces).withColumn("_head", head)
    return told.select(F.col("id").alias("query_id"), query_name(F.regexp_replace("_head", "\r$", "")).alias("qname"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def _parsed(batches):
    """Records of FASTQ lines (file, n, value) in file order: sequence and quality may span lines; the quality ends when it is as long as the sequence, and what follows it up to the next @ line belongs to it too."""
    state, head, seq, qual, size, at, file = "seek", "", [], [], 0, 0, None
    out: list[tuple] = []

    def close():
        nonlocal at, state
        if state in ("seq", "qual"):
            whole = "".join(seq)
            out.append((file, at, head, whole, "".join(qual)))
            at += 1
        state = "seek"

    for b in batches:
        for name, value in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if name != file:
                close()
                file, at = name, 0
            line = value.rstrip("\r")
            if state == "seq" and not line.startswith("+"):
                seq.append(line)
                size += len(line)
            elif state == "seq":
                state = "qual"
            elif state == "qual" and (sum(map(len, qual)) < size or not line.startswith("@")):
                qual.append(line)
            elif line.startswith("@"):
                close()
                state, head, seq, qual, size = "seq", line[1:], [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "n", "_head", "seq", "qual"])
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "n", "_head", "seq", "qual"])


def four_line(spark: SparkSession, path: str) -> bool:
    """Is every fourth line a header and every line two after it a + line?"""
    k = F.expr("n % 4")
    bad = F.when((k == 0) & (F.col("value") != ""), ~F.startswith("value", F.lit("@"))).when(k == 2, ~F.startswith("value", F.lit("+"))).otherwise(False)
    return not numbered(spark, path).where(bad).limit(1).count()


def read_fastq(spark: SparkSession, path: str, four_lines: bool | None = None) -> DataFrame:
    """(query_id, qname, seq, qual).

    With four_lines a record is four lines, and files are split. Without,
    sequence and quality may span lines: each file is parsed line by line as a
    stream. By default the lines themselves tell.
    """
    if four_lines is None:
        four_lines = four_line(spark, path)
    if four_lines:
        lines = numbered(spark, path).select("file", F.expr("n div 4").alias("n"), F.expr("cast(n % 4 as int)").alias("_k"), F.regexp_replace("value", "\r$", "").alias("value"))
        one = lambda k: F.max(F.when(F.col("_k") == k, F.col("value")))
        records = lines.groupBy("file", "n").agg(one(0).alias("_head"), one(1).alias("seq"), one(3).alias("qual")).where("_head like '@%'")
        records = records.withColumn("_head", F.expr("substring(_head, 2)"))
    else:
        ship(spark)
        lines = numbered(spark, path).repartition("file").sortWithinPartitions("file", "n")
        records = lines.mapInArrow(_parsed, "file string, n long, _head string, seq string, qual string")
    return _ids(records).select(F.col("id").alias("query_id"), query_name(F.col("_head")).alias("qname"), "seq", F.coalesce("qual", F.lit("")).alias("qual"))


def stage_input(spark: SparkSession, stream, folder: str) -> str:
    """Copies a stream of bytes, such as standard input, to a file in a folder that all executors reach, in blocks of bounded size; its path."""
    path = f"{folder.rstrip('/')}/input-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    while block := stream.read(1 << 20):
        out.write(bytearray(block))
    out.close()
    return path


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTA or FASTQ files, by the first character."""
    first = spark.read.text(path).where("value <> ''").first()
    return read_fastq(spark, path) if first and first[0].startswith("@") else read_fasta_reads(spark, path)


def validity(reads: DataFrame, p: AlignParams) -> DataFrame:
    """Adds reason: null for a usable read, else why it is skipped."""
    n = F.length("seq")
    reason = (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > p.max_query_length, "too long").when(F.col("qual").isNotNull() & (F.length("qual") != n), "quality length").when(n < p.word_len, "too short")
    )
    return reads.withColumn("reason", reason)


def usable(reads: DataFrame, p: AlignParams) -> DataFrame:
    return validity(reads, p).where("reason is null").drop("reason")


def rejected(reads: DataFrame, p: AlignParams) -> DataFrame:
    return validity(reads, p).where("reason is not null")
