"""K-mers as arrays, against strings and counters."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandweave.operators import index, seeds
from strandweave.operators import kmer_arrays as K
from strandweave.params import AlignParams
from strandweave.plans.engine import hits_without_index


def number(word):
    return sum("TCAG".index(c) * 4**i for i, c in enumerate(reversed(word)))


def made(n, length, letters="ACGT", seed=7):
    r = random.Random(seed)
    return [(i, "".join(r.choice(letters) for _ in range(r.randrange(length)))) for i in range(n)]


def of(rows, w, skip=1):
    return [(i, p, s[p : p + w]) for i, s in rows for p in range(0, len(s) - w + 1, skip) if set(s[p : p + w]) <= set("ACGT")]


@pytest.mark.parametrize("w", [1, 2, 5, 14, 15])
def test_packed_windows(w):
    rows = made(50, 60, "ACGTNx")
    b = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([s for _, s in rows])], ["chunk_id", "bases"])
    row, pos, key = K.placed(b.slice(3), w, 2, 100)
    assert list(zip(row.tolist(), pos.tolist(), key.tolist())) == [(i - 3, p, number(k)) for i, p, k in of(rows[3:], w, 2)]


def test_blocks_and_folds():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 50_000).astype(np.uint32))
    for _, i, j in K.blocks(keys, 18):
        assert (K.block_keys(K.key_block(keys[i:j]), j - i) == keys[i:j]).all()
    assert sum(j - i for _, i, j in K.blocks(keys, 18)) == len(keys)


def test_counts_over_chunks_and_tasks(spark, monkeypatch):
    rows = made(40, 400, "AC") + [(99, "ACGT" * 5000)]
    df = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    want = Counter(number(k) for _, _, k in of(rows, 15))
    assert {r["kmer"]: r["n"] for r in index.count_kmers(df).collect()} == want
    at, firsts = 0, {}
    for k in sorted(want):
        firsts[k], at = at, at + want[k]
    assert {r["kmer"]: r["first"] for r in index.prefix_sums(df).collect()} == firsts


def test_no_row_per_kmer_of_the_reference(spark):
    """Without an index, what reads don't have never becomes a row; what they have is all there."""
    rows = made(60, 4000)
    refs = spark.createDataFrame(rows, "seq_id long, seq string")
    taken = next(s[100:160] for _, s in rows if len(s) > 200)
    reads = seeds.both_strands(spark.createDataFrame([(1, taken)], "query_id long, seq string"))
    bits = index.fold(seeds.read_kmers(reads, 15))
    assert index.kmers(refs, among=bits).count() < len(of(rows, 15)) // 100
    found = {(r["query_id"], r["strand"], r["seq_id"], r["diag"], r["qo"]) for r in hits_without_index(reads, refs, AlignParams()).collect()}
    other = taken[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {(1, side, i, p - q, q) for side, text in (("+", taken), ("-", other)) for i, p, k in of(rows, 15) for q in range(46) if text[q : q + 15] == k}
    assert found == want and want


def places(rows):
    found = {}
    for i, p, k in of(rows, 15):
        found.setdefault(number(k), []).append(i * 1_000_000 + p)
    return found


def test_postings_over_tasks(spark):
    rows = made(300, 300, "AC")
    want = {k: (len(v), min(v), max(v)) for k, v in places(rows).items() if len(v) > 1}
    df = spark.createDataFrame(rows, "seq_id long, seq string").repartition(5)
    assert {r["kmer"]: tuple(r)[1:] for r in index.postings(df, 15, 1).collect()} == want and want


def test_position_counts_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(index, "BUCKET", 3000)
    rows = made(60, 400, "AC") + [(99, "ACGT" * 5000)]
    many = Counter(k for _, _, k in of(rows, 15))
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    assert Counter(map(tuple, index.position_counts(df).collect())) == Counter((i, p, many[k]) for i, p, k in of(rows, 15))


def test_sampled_positions_are_the_lowest_hashes(spark):
    """Frequent k-mers with few and with many more positions than are kept."""
    from hashlib import md5

    rows = made(200, 300, "AC", 5) + [(1000 + i, "A" * 300) for i in range(3)]
    want = {k: sorted(v, key=lambda g: md5(f"{k}:{g // 1_000_000}:{g % 1_000_000}".encode()).hexdigest())[:4] for k, v in places(rows).items()}
    got = index.sample_positions(spark.createDataFrame(rows, "seq_id long, seq string"), 4)
    assert sorted((r["kmer"], r["seq_id"] * 1_000_000 + r["pos"]) for r in got.collect()) == sorted((k, g) for k, v in want.items() for g in v)
    assert max(map(len, places(rows).values())) > 200
