"""Seeds, fragments and regions, in SQL operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequences import reverse_complement
from strandweave.operators.index import kmers
from strandweave.params import AlignParams

GROUP = ("query_id", "strand", "seq_id")


def both_strands(reads: DataFrame) -> DataFrame:
    """(query_id, strand, seq): every read as it is and reverse-complemented."""
    sides = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    return reads.select("query_id", F.explode(sides).alias("_s")).select("query_id", "_s.strand", "_s.seq")


def read_kmers(stranded: DataFrame, word_len: int) -> DataFrame:
    """(query_id, strand, qo, kmer): at every position, whatever the index's step."""
    return kmers(stranded, word_len, 1, "query_id", ("strand",), "qo")


def seed_hits(wanted: DataFrame, index: DataFrame, counts: DataFrame, p: AlignParams) -> DataFrame:
    """(query_id, strand, seq_id, diag, qo): k-mers that reads (wanted) and index share, without those that occur more than max_hits times.

    The limit acts on the reads' k-mers before the index is touched, so a
    frequent k-mer meets nothing in the join; what is left of its index rows
    lies on the join's probe side, where adaptive execution may split it.
    """
    wanted = wanted.join(counts.where(F.col("n") <= p.max_hits).select("kmer"), "kmer", "left_semi")
    hits = index.join(wanted, "kmer")
    return hits.select(*GROUP, (F.col("pos") - F.col("qo")).cast("bigint").alias("diag"), "qo")


def fragments(hits: DataFrame, word_len: int) -> DataFrame:
    """(*GROUP, diag, sqo, eqo, sro, len): hits on one diagonal that overlap or abut, as gap-free matches."""
    on = Window.partitionBy(*GROUP, "diag").orderBy("qo")
    broken = hits.withColumn("_new", F.coalesce((F.col("qo") > F.lag("qo").over(on) + word_len).cast("int"), F.lit(0)))
    islands = broken.withColumn("_island", F.sum("_new").over(on.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = islands.groupBy(*GROUP, "diag", "_island").agg(F.min("qo").alias("sqo"), (F.max("qo") + word_len - 1).alias("eqo"))
    return span.select(*GROUP, "diag", "sqo", "eqo", (F.col("diag") + F.col("sqo")).alias("sro"), (F.col("eqo") - F.col("sqo") + 1).alias("len"))


def regions(frags: DataFrame, max_gap: int) -> DataFrame:
    """Adds region (numbered from 0 by diagonal) and n_frags: a new region starts where the diagonal jumps by more than max_gap."""
    by_diag = Window.partitionBy(*GROUP).orderBy("diag", "sqo")
    jump = frags.withColumn("_new", F.coalesce((F.col("diag") - F.lag("diag").over(by_diag) > max_gap).cast("int"), F.lit(0)))
    numbered = jump.withColumn("region", F.sum("_new").over(by_diag.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")
    return numbered.withColumn("n_frags", F.count(F.lit(1)).over(Window.partitionBy(*GROUP, "region")).cast("int"))


def lone_clumps(in_regions: DataFrame, min_match: int) -> DataFrame:
    """Regions of one fragment that is long enough, as clumps of one fragment."""
    return in_regions.where((F.col("n_frags") == 1) & (F.col("len") >= min_match))
