"""How often the plan reads the sequences, and what its one pass over their k-mers keeps."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from strandweave.functions.sequences import letters_as_bases
from strandweave.operators import index, seeds, stats
from strandweave.operators import kmer_arrays as K
from strandweave.params import AlignParams
from strandweave.plans.engine import hits_without_index, plan
from strandweave.session import ship


def made(n, length, seed=3):
    r = random.Random(seed)
    return [(i, "".join(r.choice("ACGT") for _ in range(length))) for i in range(n)]


def test_sequences_are_read_twice_however_many_stages_are_used(spark):
    rows = made(40, 3000)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    refs = spark.createDataFrame(rows, "seq_id long, seq string").mapInArrow(counted, "seq_id long, seq string")
    reads = spark.createDataFrame([(i, s[500:600] + s[602:700]) for i, s in rows[:5]] + [(90, "AC" * 40)], "query_id long, seq string")
    s = plan(reads, refs, AlignParams(), again=True)
    told = {r["query_id"]: r for r in stats.query_stats(reads, s.hits, s.regions, s.alignments, s.selected).collect()}
    assert seen.value == 2 * len(rows)
    assert all(told[i]["n_reported"] == 1 and told[i]["n_seeds"] >= 168 and told[i]["n_fragments"] >= 2 for i, _ in rows[:5])
    assert told[90]["n_seeds"] == told[90]["n_reported"] == 0


def test_windows_at_the_ends_of_sequences(spark):
    """A window that reaches past a sequence of less, exactly and more than a chunk."""
    rows = [(i, s[:n]) for (i, s), n in zip(made(4, 3000), (90, 1024, 1025, 2048))]
    reads = [(10 + i, s[-60:]) for i, s in rows] + [(20 + i, s[:60]) for i, s in rows]
    found = plan(spark.createDataFrame(reads, "query_id long, seq string"), spark.createDataFrame(rows, "seq_id long, seq string")).selected
    want = {(10 + i, i, len(s) - 60, len(s) - 1, s[-60:]) for i, s in rows} | {(20 + i, i, 0, 59, s[:60]) for i, s in rows}
    assert {tuple(r) for r in found.select("query_id", "seq_id", "sro", "ero", "ref").collect()} == want


def test_frequent_kmers_leave_few_rows_and_no_hits(spark):
    """Exactly max_hits positions count; one more, and none does, whatever the pass has left out of the others."""
    p = AlignParams(max_hits=6)
    rare, six, seven, many = ("".join(c) for c in np.array_split(np.array(list(made(1, 60, 9)[0][1])), 4))
    text = "N".join([rare] + [six] * 6 + [seven] * 7 + [many] * 5000)
    refs = spark.createDataFrame([(1, text)], "seq_id long, seq string")
    reads = seeds.both_strands(spark.createDataFrame([(1, "N".join((rare, six, seven, many)))], "query_id long, seq string"))
    bits = index.fold(seeds.read_kmers(reads, 15))
    assert index.kmers(refs, among=bits, most=6).count() == 1 + 6 + 7 + 7
    assert sorted(r["qo"] for r in hits_without_index(reads, refs, p).collect()) == [0] + [16] * 6


def test_first_of_each_key():
    keys = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint32)
    for n in (1, 7, 300):
        assert K.at_most(keys, n).tolist() == [i for i in range(200) if (keys[:i] == keys[i]).sum() < n]
    assert not len(K.at_most(keys[:0], 3))


def test_folds_hold_all_of_theirs_and_few_others(spark):
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 30, 200_000)).astype(np.uint32)
    bits = index.fold(spark.createDataFrame([(int(k),) for k in keys[::2]], "kmer long"))
    assert K.held(bits, keys[::2]).all() and K.held(bits, keys[1::2]).mean() < 0.0002


def test_letters_as_bases(spark):
    texts = ["", "aZ b\nC", "é K İı ſ 日本 z", None, "=" * 50, "The quick brown fox" * 9]
    ship(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    want = {i: t and "".join("ACGT"[(ord(c) - 97) % 4] if c < "y" else "AC"[ord(c) - 121] for c in re.sub("[^A-Za-z]", "", t).lower()) for i, t in enumerate(texts)}
    assert dict(map(tuple, df.select("i", letters_as_bases(F.col("t"))).collect())) == want
