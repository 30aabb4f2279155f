"""Statistics of reads and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(out: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        out = out.join(part, "query_id", "left")
    return out.fillna(0)


def seed_stats(reads: DataFrame, hits: DataFrame, in_regions: DataFrame) -> DataFrame:
    """Per read: length, seed matches, regions and their fragments."""
    regions = in_regions.groupBy("query_id", "strand", "seq_id", "region").agg(F.count(F.lit(1)).alias("f"))
    seeds = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    return _joined(reads.select("query_id", F.length("seq").alias("query_len")), seeds, regions.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("f").alias("n_fragments")))


def query_stats(reads: DataFrame, hits: DataFrame, in_regions: DataFrame, alignments: DataFrame, selected: DataFrame) -> DataFrame:
    """Per read: seed statistics, alignments tried and reported."""
    return _joined(seed_stats(reads, hits, in_regions), *(df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)) for df, name in ((alignments, "n_alignments"), (selected, "n_reported"))))


def run_stats(per_read: DataFrame) -> DataFrame:
    """One row: reads, lengths, seeds, unaligned reads, alignments per aligned read."""
    done = F.col("n_reported") > 0
    return per_read.agg(
        F.count(F.lit(1)).alias("n_reads"), F.min("query_len").alias("min_len"), F.max("query_len").alias("max_len"), F.avg("query_len").alias("avg_len"),
        F.min("n_seeds").alias("min_seeds"), F.max("n_seeds").alias("max_seeds"), F.avg("n_seeds").alias("avg_seeds"),
        F.sum((~done).cast("long")).alias("n_unaligned"), (F.sum("n_reported") / F.sum(done.cast("long"))).alias("reported_per_aligned"),
    )


def unaligned_reads(reads: DataFrame, selected: DataFrame) -> DataFrame:
    return reads.join(selected.select("query_id"), "query_id", "left_anti")


def span_text(seconds: float) -> str:
    """A duration such as 1H2M3.50S."""
    hours, rest = divmod(max(0.0, seconds), 3600)
    minutes, left = divmod(rest, 60)
    return (f"{int(hours)}H" if hours else "") + (f"{int(minutes)}M" if hours or minutes else "") + f"{left:.2f}S"
