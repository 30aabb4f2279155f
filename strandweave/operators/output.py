"""Alignment rows as SAM records and tab-separated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.edits import cigar, edit_distance, md
from strandweave.functions.sequences import normalise, reverse_complement
from strandweave.params import AlignParams

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam_rows(selected: DataFrame, reads: DataFrame, sequences: DataFrame, p: AlignParams, clip: str = "H") -> DataFrame:
    """The 11 SAM columns and a column of tags. reads: query_id, qname, seq, qual (may be null); sequences: seq_id, name.

    clip is H or S: with H, SEQ and QUAL hold the aligned bases alone.
    """
    if clip not in ("H", "S"):
        raise ValueError("clip must be H or S")
    back = F.col("strand") == "-"
    told = selected.join(reads.select("query_id", "qname", F.col("seq").alias("_seq"), F.col("qual").alias("_qual")), "query_id").join(sequences.select("seq_id", "name"), "seq_id")
    seq = F.when(back, reverse_complement(normalise(F.col("_seq")))).otherwise(F.col("_seq"))
    qual = F.when(back, F.reverse("_qual")).otherwise(F.col("_qual"))
    start, size = F.col("sqo") + 1, F.col("eqo") - F.col("sqo") + 1
    shown = (lambda c: F.substring(c, start, size)) if clip == "H" else (lambda c: c)
    tags = [
        F.concat(F.lit("AS:i:"), "score"), F.concat(F.lit("NM:i:"), edit_distance(F.col("ops"))), F.concat(F.lit("MD:Z:"), md(F.col("ops"), F.col("ref"))),
        F.concat(F.lit("YF:Z:"), F.lower(F.lpad(F.hex("status"), 2, "0"))), F.when(F.col("matched_primary").isNotNull(), F.concat(F.lit("YI:i:"), "matched_primary")),
        F.when(F.col("n_primaries").isNotNull(), F.concat(F.lit("YP:i:"), "n_primaries")), F.when(F.col("n_secondaries").isNotNull(), F.concat(F.lit("YS:i:"), "n_secondaries")),
    ]
    return told.select(
        "query_id", "qname", F.when(back, 16).otherwise(0).alias("flag"), F.col("name").alias("rname"), (F.col("sro") + 1).alias("pos"), "mapq",
        cigar(F.col("ops"), F.col("sqo"), F.col("query_len") - 1 - F.col("eqo"), clip).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        shown(seq).alias("seq"), F.coalesce(shown(qual), F.lit("*")).alias("qual"), F.array_join(F.array_compact(F.array(*tags)), "\t").alias("tags"),
    )


def sam_header(sequences: DataFrame, p: AlignParams, program: str = "strandweave") -> DataFrame:
    """(n, line): @HD, one @SQ per sequence, @PG with every parameter; n gives the order."""
    spark = sequences.sparkSession
    told = " ".join(f"{k}={v}" for k, v in sorted(vars(p).items()))
    ends = spark.createDataFrame([(-1, "@HD\tVN:1.0"), (1 << 40, f"@PG\tID:{program}\tCL:{told}")], "n bigint, line string")
    each = sequences.select(F.col("seq_id").cast("bigint").alias("n"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("seq")).alias("line"))
    return ends.unionByName(each)


def sam_lines(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.concat_ws("\t", *(F.col(c).cast("string") for c in (*SAM, "tags"))).alias("value"))


def report_rows(selected: DataFrame, reads: DataFrame, sequences: DataFrame) -> DataFrame:
    """The 14-column tab-separated report; positions from 1, reference ends swapped on the reverse strand, percentages of matches."""
    told = selected.join(reads.select("query_id", "qname"), "query_id").join(sequences.select("seq_id", "name"), "seq_id")
    back = F.col("strand") == "-"
    low, high = F.col("sro") + 1, F.col("ero") + 1
    percent = lambda whole: F.round(100.0 * F.col("matches") / F.col(whole), 2)
    return told.select(
        "qname", F.col("name").alias("rname"), percent("aln_len").alias("identity"), "aln_len", "mismatches", "gap_bases", (F.col("psqo") + 1).alias("qstart"), (F.col("peqo") + 1).alias("qend"),
        F.when(back, high).otherwise(low).alias("rstart"), F.when(back, low).otherwise(high).alias("rend"), "strand", "score", "query_len", percent("query_len").alias("coverage"),
    )


def write_sam(rows: DataFrame, header: DataFrame, path: str) -> None:
    """Header and records as text under path/header and path/records; a read's records are neighbours in one file."""
    header.coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(f"{path}/header")
    sam_lines(rows).repartition("query_id").sortWithinPartitions("query_id", "value").select("value").write.mode("overwrite").text(f"{path}/records")


def write_report(rows: DataFrame, path: str) -> None:
    rows.repartition("qname").sortWithinPartitions("qname", "qstart").write.mode("overwrite").csv(path, sep="\t")
