from pyspark.sql import functions as F

from strandweave.functions import edits, intervals, sequences
from strandweave.params import AlignParams

P = AlignParams()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_bases(spark):
    lit = F.lit
    assert one(spark, sequences.complement(lit("ACGTUNBDHKMRSVWXY"))) == "TGCAANVHDMKYSBWXR"
    assert one(spark, sequences.reverse_complement(lit("AACGT"))) == "ACGTT"
    assert one(spark, sequences.normalise(lit("acguTn-é*x"))) == "ACGTTNXXXX"
    assert one(spark, sequences.pack_kmer(lit("ACGT"))) == 156
    assert one(spark, sequences.pack_kmer(lit("ACGN"))) is None
    assert one(spark, sequences.unpack_kmer(lit(156), 6)) == "TTACGT"
    assert [one(spark, sequences.base_code(lit(b))) for b in "TCAGNY"] == [0, 1, 2, 3, 4, 15]
    assert one(spark, sequences.code_base(lit(15))) == "Y"
    assert one(spark, sequences.query_name(lit("a b" + "x" * 300))) == ("a_b" + "x" * 300)[:200]
    assert one(spark, sequences.wrapped(lit("A" * 101))) == "A" * 50 + "\n" + "A" * 50 + "\nA"


def test_costs(spark):
    assert [one(spark, intervals.gap_cost(F.lit(n), P)) for n in (0, 1, 10)] == [0, -7, -25]
    same = lambda d: one(spark, intervals.breakpoint_penalty(F.lit(True), F.lit(d), P))
    assert [same(d) for d in (0, 10, 1000, 50_000, 100_000, 10**7)] == [5, 5, 15, 23, 25, 25]
    assert one(spark, intervals.breakpoint_penalty(F.lit(False), F.lit(0), P)) == 25
    none = F.lit(None).cast("int")
    q = lambda b, s, t: one(spark, intervals.mapping_quality(F.lit(b), s, t))
    assert [q(100, none, none), q(100, F.lit(80), none), q(100, F.lit(80), F.lit(60)), q(100, F.lit(100), none)] == [250, 50, 35, 0]


def test_edits(spark):
    def ops(text):
        import re

        return F.array(*[F.struct(F.lit(o).alias("op"), F.lit(int(n)).alias("len")) for n, o in re.findall(r"(\d+)([MRID])", text)])

    o = ops("50M1R49M2I30M")
    assert one(spark, edits.edit_score(o, P)) == 129 - 3 - 9
    assert one(spark, edits.edit_distance(o)) == 3
    assert one(spark, edits.cigar(o, F.lit(3), F.lit(5))) == "3H100M2I30M5H"
    assert abs(one(spark, edits.identity(o)) - 129 / 132) < 1e-12
    assert one(spark, edits.md(ops("2M2R1D1R2I1M"), F.lit("ACGTAGC"))) == "2G0T0^A0G1"
    assert one(spark, edits.score_of_first(o, F.lit(51), P)) == 47
    assert one(spark, edits.score_of_last(o, F.lit(32), P)) == 30 - 9
    assert one(spark, edits.score_of_first(ops("3M2D4M"), F.lit(3), P)) == 3
    assert one(spark, edits.score_of_first(ops("3M2D4M"), F.lit(4), P)) == 3 - 9 + 1
    assert one(spark, edits.has_match_run(o, 50)) and not one(spark, edits.has_match_run(o, 51))
    assert one(spark, edits.best_core(ops("10M5R20M1R5M"), P)) == 22


def test_parameters():
    assert P.min_extension == 5 and P.min_non_overlap == 25 and P.max_intron == 50 and P.min_raw_score == 25
    plain = AlignParams(affine=False, max_distance_log=99)
    assert (plain.match, plain.replace, plain.gap_open, plain.gap_extend, plain.max_distance_log) == (1, 1, 0, 1, 9)
    for bad in ({"word_len": 16}, {"skip_dist": 16}, {"min_identity": 0.0}):
        try:
            AlignParams(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
