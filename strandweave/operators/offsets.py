"""Positions in all sequences laid end to end, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096
BIN = 1 << 20


def sequence_offsets(sequences: DataFrame) -> DataFrame:
    """(seq_id, start, length): sums run within ranges of ids, and over the ranges' totals."""
    sized = sequences.select("seq_id", F.length("seq").cast("bigint").alias("length")).withColumn("_r", F.expr(f"seq_id div {RANGE}"))
    totals = sized.groupBy("_r").agg(F.sum("length").alias("_t"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_r", F.coalesce(F.sum("_t").over(earlier(Window.orderBy("_r"))), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("length").over(earlier(Window.partitionBy("_r").orderBy("seq_id"))), F.lit(0))
    return sized.withColumn("_i", inside).join(before, "_r").select("seq_id", (F.col("_b") + F.col("_i")).alias("start"), "length")


def locate(positions: DataFrame, offsets: DataFrame, column: str = "offset") -> DataFrame:
    """Adds seq_id and pos to positions that lie in a sequence: an interval join as an equi-join on bins of the line."""
    spread = offsets.where("length > 0").select("*", F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"(start + length - 1) div {BIN}"))).alias("_bin"))
    near = positions.withColumn("_bin", F.expr(f"`{column}` div {BIN}")).join(spread, "_bin")
    inside = (F.col(column) >= F.col("start")) & (F.col(column) < F.col("start") + F.col("length"))
    return near.where(inside).withColumn("pos", F.col(column) - F.col("start")).drop("_bin", "start", "length")
