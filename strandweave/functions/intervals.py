"""Column expressions on positions: fragments, diagonals, gaps, overlaps, breakpoints, mapping quality.

Intervals are zero-based and inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandweave.params import NO_COMPETITOR_MAPQ, AlignParams


def diagonal(ref_off: Column, query_off: Column) -> Column:
    return ref_off.cast("bigint") - query_off


def gap_between(left_end: Column, right_start: Column) -> Column:
    """Positions strictly between two intervals."""
    return F.greatest(right_start - left_end - 1, F.lit(0))


def overlap_between(left_end: Column, right_start: Column) -> Column:
    """Positions that the left interval's end and the right interval's start share."""
    return F.greatest(left_end - right_start + 1, F.lit(0))


def interval_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1, F.lit(0))


def gap_cost(n: Column, p: AlignParams) -> Column:
    return F.when(n > 0, -(F.lit(p.gap_open) + n * p.gap_extend)).otherwise(0)


def plus_start(strand: Column, start: Column, end: Column, query_len: Column) -> Column:
    """Start of a read interval in the read's own direction."""
    return F.when(strand == "-", query_len - 1 - end).otherwise(start)


def plus_end(strand: Column, start: Column, end: Column, query_len: Column) -> Column:
    return F.when(strand == "-", query_len - 1 - start).otherwise(end)


def breakpoint_penalty(same_sequence: Column, distance: Column, p: AlignParams) -> Column:
    """The cost of joining two alignments: constant when near, logarithmic in the distance, most across sequences."""
    log = F.least(F.log10(F.greatest(distance, F.lit(1)).cast("double")), F.lit(float(p.max_distance_log)))
    far = F.floor(log * p.breakpoint_penalty + 0.5)
    return F.when(~same_sequence, p.max_distance_log * p.breakpoint_penalty).when(distance <= 10, p.breakpoint_penalty).otherwise(far).cast("int")


def mapping_quality(best: Column, second: Column, third: Column) -> Column:
    """From a primary's score and its two best competitors (null: none)."""
    share = lambda s: F.when(s.isNull(), 1.0).otherwise(F.greatest(best - s, F.lit(0)) / best)
    scaled = F.floor(F.lit(float(NO_COMPETITOR_MAPQ)) * share(second) * (1 + share(third)) / 2 + 0.5)
    return F.when(second.isNull(), NO_COMPETITOR_MAPQ).otherwise(scaled).cast("int")


def status_has(status: Column, bit: int) -> Column:
    return status.bitwiseAND(F.lit(bit)) != 0


def status_set(status: Column, bit: int) -> Column:
    return status.bitwiseOR(F.lit(bit))
