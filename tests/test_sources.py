import random

import pytest

from strandweave.operators import index, output
from strandweave.params import AlignParams
from strandweave.plans.engine import plan
from strandweave.sources import packed, text

P = AlignParams()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_genome_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>chr1 first one\nACGT\nacgu\n\n>chr2\r\nNN-*\r\nGG\n")
    (tmp_path / "b.fa").write_text(">only\n" + "ACGTACGTAC\n" * 20)
    got = rows(text.read_genome(spark, str(tmp_path)), "seq_id", "name", "seq")
    assert got == [(0, "chr1", "ACGTACGT"), (1, "chr2", "NNXXGG"), (2, "only", "ACGTACGTAC" * 20)]


def test_fasta_reads(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">read one x\nACG\nTT\n>two\n\n>" + "n" * 250 + "\nAC\n")
    got = rows(text.read_reads(spark, str(tmp_path / "r.fa")), "query_id", "qname", "seq", "qual")
    assert got == [(0, "read_one_x", "ACGTT", None), (1, "two", "", None), (2, "n" * 200, "AC", None)]


def test_fastq_with_at_signs_in_qualities(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a 1\nACGT\n+a 1\n@III\n@b\nAC\n+\n+@\n@c\nACG\n+\nIII\n")
    got = rows(text.read_reads(spark, str(tmp_path / "r.fq")), "query_id", "qname", "seq", "qual")
    assert got == [(0, "a_1", "ACGT", "@III"), (1, "b", "AC", "+@"), (2, "c", "ACG", "III")]


def test_large_fastq_is_split_and_numbered(spark, tmp_path):
    r = random.Random(1)
    reads = [("".join(r.choice("ACGT") for _ in range(r.randint(1, 60)))) for _ in range(3000)]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(reads)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = text.read_fastq(spark, str(tmp_path / "r.fq"))
        got = rows(df, "query_id", "qname", "seq", "qual")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((i, f"r{i}", s, "@" * len(s)) for i, s in enumerate(reads))


def test_multi_line_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a\nAC\nGT\n+x\nII\n@@\n@b 2\r\nACG\r\n+\r\nIII\r\n@c\nA\n+\nII\nI\n\n@d\n\n+\n\n@e\nAC\n+\n@I")
    (tmp_path / "s.fq").write_text("@f\nACGT\n+\nIIII\n")
    got = rows(text.read_reads(spark, str(tmp_path)), "query_id", "qname", "seq", "qual")
    assert got == [(0, "a", "ACGT", "II@@"), (1, "b_2", "ACG", "III"), (2, "c", "A", "III"), (3, "d", "", ""), (4, "e", "AC", "@I"), (5, "f", "ACGT", "IIII")]


def test_standard_input_is_staged(spark, tmp_path):
    import io

    path = text.stage_input(spark, io.BytesIO(b"@a\nACGT\n+\nIIII\n" * 3), str(tmp_path))
    assert rows(text.read_reads(spark, path), "query_id", "seq") == [(0, "ACGT"), (1, "ACGT"), (2, "ACGT")]


def test_validity(spark):
    df = spark.createDataFrame([(1, "A" * 20, None), (2, "", None), (3, None, None), (4, "ACGT", None), (5, "A" * 33_000, None), (6, "A" * 20, "I" * 19)], "query_id int, seq string, qual string")
    got = dict(rows(text.validity(df, P), "query_id", "reason"))
    assert got == {1: None, 2: "empty", 3: "empty", 4: "too short", 5: "too long", 6: "quality length"}
    assert text.usable(df, P).count() == 1 and text.rejected(df, P).count() == 5


def test_packed_round_trip(spark, tmp_path):
    r = random.Random(2)
    seqs = [(f"s{i}", "".join(r.choice("ACGTNRYX") for _ in range(n))) for i, n in enumerate((0, 1, 2, 7, 8, 9, 1000))]
    data = packed.encode(seqs)
    assert packed.decode(data) == seqs and len(data) % 4 == 0
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, name string, seq string")
    packed.write_packed(df, str(tmp_path / "g"), 2)
    assert rows(packed.read_packed(spark, str(tmp_path / "g")), "name", "seq") == sorted(seqs)
    packed.write_fasta(df.where("seq <> ''"), str(tmp_path / "fa"))
    assert rows(text.read_genome(spark, str(tmp_path / "fa" / "*.txt")), "name", "seq") == sorted(x for x in seqs if x[1])
    with pytest.raises(ValueError):
        packed.decode(b"\0" * 32)


def test_version_one_of_the_packed_format():
    import struct

    names = b"ab" + b"\0\0"
    body = bytes([0x21, 0x30])  # A C G T
    data = struct.pack("<4I", packed.MARKER, 1, 16 + 12 + 4 + 4, 1) + struct.pack("<3I", 0, 4, 0 << 16 | 2) + struct.pack("<I", 0) + names + body
    assert packed.decode(data) == [("ab", "ACGT")]


def genome(spark):
    r = random.Random(3)
    chars = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seqs = [(0, "chrA", chars(5000)), (1, "chrB", chars(3000)), (2, "tiny", "ACGT"), (3, "empty", "")]
    return seqs, spark.createDataFrame(seqs, "seq_id long, name string, seq string")


def test_saved_index_gives_the_same_alignments(spark, tmp_path):
    seqs, df = genome(spark)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = seqs[0][2], seqs[1][2]
    reads = [
        (0, "plain", a[100:400], None), (1, "back", rc(b[500:800]), None), (2, "joined", a[1000:1200] + b[2000:2200], None), (3, "inverted", a[2000:2150] + rc(a[2150:2300]) + a[2300:2450], None),
        (4, "deleted", a[3000:3200] + a[3900:4100], "I" * 400), (5, "nothing", "ACGT" * 10, None), (6, "short", "ACGT", None),
    ]
    rd = spark.createDataFrame(reads, "query_id long, qname string, seq string, qual string")
    spark.sql("DROP TABLE IF EXISTS test_index")
    index.write_index(index.build_index(df, P), "test_index", P, 4)
    saved, p = index.read_index(spark, "test_index", P)
    assert p.max_hits == 650 and index.holds(df, saved, p.word_len).where("not holds").count() == 0
    cols = ("query_id", "strand", "seq_id", "psqo", "peqo", "sro", "ero", "primary_ix", "n_primaries", "mapq", "score")
    found = plan(rd, df, P).selected
    got = rows(found, *cols)
    assert rows(plan(rd, df, p, saved).selected, *cols) == got
    by = {}
    for x in got:
        by.setdefault(x[0], []).append(x)
    assert set(by) == {0, 1, 2, 3, 4}
    assert by[0][0][1:7] == ("+", 0, 0, 299, 100, 399) and by[1][0][1:7] == ("-", 1, 0, 299, 500, 799)
    assert [x[2] for x in sorted(by[2], key=lambda x: x[7])] == [0, 1] and all(abs(x[3] - e) <= 5 for x, e in zip(sorted(by[2], key=lambda x: x[7]), (0, 200)))
    assert [x[1] for x in sorted(by[3], key=lambda x: x[7])] == ["+", "-", "+"]
    assert len(by[4]) == 2 and all(x[9] == 250 for x in got)
    sam = {(r["qname"], r["pos"]): r for r in output.sam_rows(found, rd, df, P).collect()}
    import re

    for (name, pos), r in sam.items():
        size = sum(int(n) for n, op in re.findall(r"(\d+)([MIDHS])", r["cigar"]) if op in "MI")
        assert size == len(r["seq"]) and "MD:Z:" in r["tags"]
        assert sum(int(n) for n, op in re.findall(r"(\d+)([MIDHS])", r["cigar"]) if op in "MIH") == next(len(x[2]) for x in reads if x[1] == name)
    assert sam[("back", 501)]["flag"] == 16 and sam[("back", 501)]["seq"] == b[500:800]
    soft = output.sam_rows(found, rd, df, P, clip="S").where("qname = 'deleted'").collect()
    assert all(len(r["seq"]) == 400 and r["qual"] == "I" * 400 for r in soft)
    report = {(r["qname"], r["qstart"]): r for r in output.report_rows(found, rd, df).collect()}
    assert report[("back", 1)]["rstart"] == 800 and report[("back", 1)]["rend"] == 501 and report[("plain", 1)]["identity"] == 100.0
    output.write_sam(output.sam_rows(found, rd, df, P), output.sam_header(df, P), str(tmp_path / "sam"))
    assert spark.read.text(str(tmp_path / "sam" / "header")).count() == 6
    assert spark.read.text(str(tmp_path / "sam" / "records")).count() == len(got)
    spark.sql("DROP TABLE test_index")


def test_result_does_not_depend_on_partitions(spark):
    seqs, df = genome(spark)
    a = seqs[0][2]
    r = random.Random(9)
    reads = [(i, "".join(c if r.random() > 0.01 else r.choice("ACGT") for c in a[s : s + 400])) for i, s in enumerate(range(0, 4600, 230))]
    rd = spark.createDataFrame(reads, "query_id long, seq string")
    cols = ("query_id", "strand", "seq_id", "psqo", "peqo", "sro", "ero", "score", "mapq")
    p = P.with_(similar=True)
    assert rows(plan(rd.coalesce(1), df.coalesce(1), p).selected, *cols) == rows(plan(rd.repartition(7), df.repartition(3), p).selected, *cols)


def test_empty_inputs(spark):
    seqs, df = genome(spark)
    none = spark.createDataFrame([], "query_id long, seq string")
    assert plan(none, df, P).selected.count() == 0
    assert plan(spark.createDataFrame([(1, "A" * 40)], "query_id long, seq string"), df.limit(0), P).selected.count() == 0
