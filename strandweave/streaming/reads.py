"""Reads that arrive as a stream, aligned batch by batch against fixed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.params import AlignParams
from strandweave.plans.engine import plan
from strandweave.session import discard

READS = "query_id bigint, qname string, seq string, qual string"


def stream_reads(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files as they appear under path."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def align_stream(reads: DataFrame, sequences: DataFrame, out: str, checkpoint: str, p: AlignParams | None = None, kmer_index: DataFrame | None = None, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write each batch's alignments under out/batch=N; a batch that is run again replaces its own files, so each read counts once."""

    def run(batch: DataFrame, number: int) -> None:
        stages = plan(batch, sequences, p, kmer_index)
        stages.selected.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if also:
            also(batch, number)
        discard(*stages.kept)

    return reads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def length_windows(reads: DataFrame, time_col: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Reads and bases per time window, with late data up to a watermark."""
    timed = reads.withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window)).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))
