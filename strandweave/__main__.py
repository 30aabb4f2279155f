"""Command line: python -m strandweave index|align|compress|uncompress ..."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from strandweave.operators import index, output, stats
from strandweave.params import AlignParams
from strandweave.plans.engine import plan
from strandweave.sources import packed, text

#: Short flags and the parameters they set.
FLAGS = {
    "L": "word_len", "S": "skip_dist", "H": "max_hits", "BW": "band_width", "G": "max_gap", "I": "max_intron", "M": "min_match", "R": "min_raw_score", "MD": "max_desert", "P": "min_identity", "X": "x_cutoff",
    "AGS": "affine", "GOC": "gap_open", "GEC": "gap_extend", "MS": "match", "RC": "replace", "OQC": "optimal_coverage", "BP": "breakpoint_penalty", "MGDP": "max_distance_log", "MNO": "min_non_overlap",
    "FBS": "similar", "PRL": "reciprocal_length", "PSS": "score_ratio",
}
_YES = {"affine", "optimal_coverage", "similar"}
_SHARES = {"min_identity", "reciprocal_length", "score_ratio"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandweave")
    top.add_argument("mode", choices=("index", "align", "compress", "uncompress"))
    top.add_argument("-g", "--genome", help="FASTA or packed genome")
    top.add_argument("-x", "--index", help="table of a saved index")
    top.add_argument("-q", "--reads", default="-", help="FASTA or FASTQ files; - or stdin reads standard input")
    top.add_argument("-o", "--out", help="folder of results")
    top.add_argument("--force", action="store_true", help="compress even if the packed genome is as new as its source")
    top.add_argument("-v", "--verbose", action="store_true", help="report the time of each phase")
    top.add_argument("-f", "--format", choices=("sam-hard", "sam-soft", "report"), default="sam-hard")
    for flag, name in FLAGS.items():
        kind = (lambda v: v.upper() in ("Y", "YES", "TRUE", "1")) if name in _YES else float if name in _SHARES else int
        top.add_argument(f"-{flag}", dest=name, type=kind, default=None)
    return top


def params(args: argparse.Namespace) -> AlignParams:
    given = {n: getattr(args, n) for n in FLAGS.values() if getattr(args, n) is not None}
    if args.mode == "index" and "max_hits" in given:
        given["index_max_hits"] = given.pop("max_hits")
    return AlignParams(**given)


def genome(spark: SparkSession, path: str):
    return packed.read_packed(spark, path) if path.endswith(".nib2") else text.read_genome(spark, path)


class Phases:
    """Wall-clock seconds by phase. Plans are lazy: the phase that writes also holds what it computes."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.began = time.monotonic()

    def end(self, name: str) -> None:
        now = time.monotonic()
        self.seconds[name] = self.seconds.get(name, 0.0) + now - self.began
        self.began = now

    def lines(self) -> list[str]:
        total = sum(self.seconds.values())
        return [f"{name}\t{stats.span_text(s)}\t{100 * s / total if total else 0:.1f} %" for name, s in self.seconds.items()] + [f"total\t{stats.span_text(total)}"]


def given_reads(spark: SparkSession, path: str, stream=None) -> str:
    """The path of the reads; standard input is first copied to the shared folder."""
    if path not in ("-", "stdin"):
        return path
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise SystemExit("reads from standard input need spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandweave-")
    return text.stage_input(spark, stream or sys.stdin.buffer, folder)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandweave").getOrCreate()
    p = params(args)
    if not args.genome:
        raise SystemExit("a genome is needed")
    phases = Phases()
    sequences = genome(spark, args.genome)
    phases.end("genome")
    if args.mode == "index":
        index.write_index(index.build_index(sequences, p), args.index or index.index_name(p.word_len, p.skip_dist, p.index_max_hits), p)
    elif args.mode == "compress":
        if args.force or not packed.newer_than(spark, args.out, args.genome):
            packed.write_packed(sequences, args.out)
    elif args.mode == "uncompress":
        packed.write_fasta(sequences, args.out)
    else:
        saved = None
        if args.index:
            saved, p = index.read_index(spark, args.index, p)
        reads = text.usable(text.read_reads(spark, given_reads(spark, args.reads)), p)
        phases.end("reads")
        found = plan(reads, sequences, p, saved).selected
        phases.end("plan")
        if args.format == "report":
            output.write_report(output.report_rows(found, reads, sequences), args.out)
        else:
            rows = output.sam_rows(found, reads, sequences, p, "S" if args.format == "sam-soft" else "H")
            output.write_sam(rows, output.sam_header(sequences, p), args.out)
    phases.end("write")
    if args.verbose:
        print("\n".join(phases.lines()), file=sys.stderr)


if __name__ == "__main__":
    main()
