import random

from strandweave.streaming.reads import READS, align_stream, length_windows, stream_reads


def test_batches_are_aligned_once(spark, tmp_path):
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(3000))
    sequences = spark.createDataFrame([(0, "chr", ref)], "seq_id long, name string, seq string")
    for k in range(2):
        rows = [(10 * k + i, f"r{k}{i}", ref[s : s + 100], None) for i, s in enumerate(range(100 * k, 2000, 500))]
        spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        align_stream(stream_reads(spark, str(tmp_path / "in"), 1), sequences, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("query_id").distinct().count() == out.count() == 8
    assert {r["batch"] for r in out.select("batch").distinct().collect()} == {0, 1}


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:03:00' + make_dt_interval(0, 0, cast(id as int)) as ts, 'ACGT' as seq from range(30)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, seq string").parquet(str(tmp_path / "in"))
    q = length_windows(stream).writeStream.format("memory").queryName("lengths").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["n_reads"], r["n_bases"]) for r in spark.sql("select * from lengths").collect())
    assert sum(n for n, _ in got) == 30 and sum(b for _, b in got) == 120 and len(got) == 4
