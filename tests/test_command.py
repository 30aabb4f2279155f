import random

from strandweave.__main__ import main, params, parser


def test_flags():
    p = params(parser().parse_args(["align", "-L", "11", "-OQC", "N", "-P", "0.8", "-H", "100"]))
    assert (p.word_len, p.optimal_coverage, p.min_identity, p.max_hits) == (11, False, 0.8, 100)
    assert params(parser().parse_args(["index", "-H", "100"])).index_max_hits == 100


def test_index_then_align(spark, tmp_path, capsys):
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(2000))
    (tmp_path / "g.fa").write_text(f">chr1 x\n{ref}\n")
    (tmp_path / "r.fq").write_text(f"@a\n{ref[50:150]}\n+\n{'@' * 100}\n@b\n{ref[500:520]}\n+\nI\n")
    spark.sql("DROP TABLE IF EXISTS cli_index")
    main(["index", "-g", str(tmp_path / "g.fa"), "-x", "cli_index", "-L", "12"], spark)
    main(["align", "-g", str(tmp_path / "g.fa"), "-x", "cli_index", "-q", str(tmp_path / "r.fq"), "-o", str(tmp_path / "sam")], spark)
    (line,) = [x[0] for x in spark.read.text(str(tmp_path / "sam" / "records")).collect()]
    assert line.split("\t")[:6] == ["a", "0", "chr1", "51", "250", "100M"]
    main(["align", "-g", str(tmp_path / "g.fa"), "-q", str(tmp_path / "r.fq"), "-o", str(tmp_path / "rep"), "-f", "report"], spark)
    assert spark.read.csv(str(tmp_path / "rep"), sep="\t").first()[2] == "100.0"
    main(["compress", "-g", str(tmp_path / "g.fa"), "-o", str(tmp_path / "p")], spark)
    main(["uncompress", "-g", str(tmp_path / "p" / "part-00000.nib2"), "-o", str(tmp_path / "fa")], spark)
    assert "".join(x[0] for x in spark.read.text(str(tmp_path / "fa")).collect()).replace(">chr1", "").replace("\n", "") == ref
    made = sorted((tmp_path / "p").iterdir())[-1].stat().st_mtime_ns
    main(["compress", "-g", str(tmp_path / "g.fa"), "-o", str(tmp_path / "p"), "-v"], spark)
    assert sorted((tmp_path / "p").iterdir())[-1].stat().st_mtime_ns == made and "total\t" in capsys.readouterr().err
    main(["compress", "-g", str(tmp_path / "g.fa"), "-o", str(tmp_path / "p"), "--force"], spark)
    assert sorted((tmp_path / "p").iterdir())[-1].stat().st_mtime_ns > made
    spark.sql("DROP TABLE cli_index")
