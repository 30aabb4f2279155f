"""The alignment plan: from reads and sequences to reported alignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import align, chain, index, seeds, select
from strandweave.params import AlignParams
from strandweave.session import materialize


@dataclass
class Stages:
    """Every stage of one alignment plan, lazily but for the tables in kept, which were written."""

    stranded: DataFrame
    hits: DataFrame
    fragments: DataFrame
    regions: DataFrame
    clumps: DataFrame
    alignments: DataFrame
    selected: DataFrame
    kept: tuple[DataFrame, ...] = ()


def hits_without_index(stranded: DataFrame, sequences: DataFrame, p: AlignParams) -> DataFrame:
    """Seed hits straight from sequences: only k-mers that reads have are counted and joined.

    A fold of the reads' k-mers, made at once, keeps nearly all others from
    becoming rows; the few it lets pass meet no read. What is left, a small part
    of the sequences' k-mers, is written, so that all uses share one pass over them.
    """
    found = shared_kmers(stranded, sequences, p)
    return seeds.seed_hits(seeds.read_kmers(stranded, p.word_len), found, index.kmer_counts(found), p)


def shared_kmers(stranded: DataFrame, sequences: DataFrame, p: AlignParams) -> DataFrame:
    """(seq_id, pos, kmer), written: the sequences' k-mers that reads may have. Of those with more than max_hits positions not all need be there, but more than max_hits."""
    bits = index.fold(seeds.read_kmers(stranded, p.word_len))
    return materialize(index.kmers(sequences, p.word_len, p.skip_dist, among=bits, most=p.max_hits), "kmers")


def plan(reads: DataFrame, sequences: DataFrame, p: AlignParams | None = None, kmer_index: DataFrame | None = None, again: bool = False) -> Stages:
    """reads: query_id, seq; sequences: seq_id, seq; kmer_index: a saved index of the same sequences, if there is one.

    The sequences are read once for k-mers and once for the windows around
    clumps, then only those that have any. again: regions and alignments are
    written too, for those who read them more than once.
    """
    p = p or AlignParams()
    kept = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        kept.append(materialize(df, label))
        return kept[-1]

    stranded = seeds.both_strands(reads.where(F.length("seq").between(p.word_len, p.max_query_length)))
    if kmer_index is None:
        kmer_index = shared_kmers(stranded, sequences, p)
        kept.append(kmer_index)
    hits = seeds.seed_hits(seeds.read_kmers(stranded, p.word_len), kmer_index, index.kmer_counts(kmer_index), p)
    frags = seeds.fragments(hits, p.word_len)
    in_regions = seeds.regions(frags, p.max_gap)
    if again:
        in_regions = keep(in_regions, "regions")
    clumps = keep(chain.chain_clumps(in_regions, p), "clumps")
    found = align.align_clumps(clumps, sequences, stranded, p)
    if again:
        found = keep(found, "alignments")
    return Stages(stranded, hits, frags, in_regions, clumps, found, select.select_alignments(found, p), tuple(kept))
