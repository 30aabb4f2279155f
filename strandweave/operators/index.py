"""The k-mer index: chunks, k-mers, counts, caps and statistics.

Long sequences are cut into chunks before anything looks at single
positions: cutting a string by position takes time in the position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequences import pack_kmer
from strandweave.operators import kmer_arrays as K
from strandweave.params import AlignParams
from strandweave.session import ship

#: Bases per chunk of the reference, and per piece that k-mers are taken from.
CHUNK, PIECE = 1024, 8192
#: Bases per bucket of chunks that asks for counts at once.
BUCKET = 1 << 22


def chunks(sequences: DataFrame, id_col: str = "seq_id", chunk: int = CHUNK, overlap: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, chunk_id, bases): pieces of `chunk` bases, each with up to `overlap` (at most chunk) bases of the next one, in one pass over a sequence."""
    pieces = sequences.select(id_col, *keep, F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("_p"))
    at = pieces.select(id_col, *keep, "_p", F.posexplode_outer("_p").alias("chunk_id", "bases")).where("bases is not null")
    tail = F.substring(F.coalesce(F.get("_p", F.col("chunk_id") + 1), F.lit("")), 1, overlap)
    return at.select(id_col, *keep, "chunk_id", (F.concat("bases", tail) if overlap else F.col("bases")).alias("bases"))


def kmers(sequences: DataFrame, word_len: int = 15, skip: int = 1, id_col: str = "seq_id", keep: tuple[str, ...] = (), pos_col: str = "pos", among: np.ndarray | None = None, most: int | None = None) -> DataFrame:
    """(id, *keep, pos, kmer bigint): every window of ACGT alone whose start is a multiple of skip, packed; sequences shorter than word_len have none.

    among: a fold of k-mers (see fold); windows whose bits aren't set stay out.
    most: of a k-mer that a slice of the bases has more often, one more than
    that stays; for those who then use only k-mers that have at most so many.
    """
    ship(sequences.sparkSession)
    cut = chunks(sequences, id_col, PIECE, word_len - 1, keep)
    names = [id_col, *keep]
    bits = None if among is None else sequences.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        for whole in batches:
            for b in K.slices(whole):
                row, pos, key = K.placed(b, word_len, skip, PIECE, None if bits is None else bits.value)
                if most is not None:
                    on = K.at_most(key, most + 1)
                    row, pos, key = row[on], pos[on], key[on]
                for i in range(0, len(row), K.OUT):
                    own = b.select(names).take(pa.array(row[i : i + K.OUT]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pos[i : i + K.OUT].astype(np.int32)), pa.array(key[i : i + K.OUT].astype(np.int64))], [*names, pos_col, "kmer"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(names).schema)
    return cut.mapInArrow(run, f"{kinds}, {pos_col} int, kmer bigint")


def fold(some: DataFrame) -> np.ndarray:
    """Which k-mers may be among some's: a bit for each of two hashes of a k-mer, 8 MB whatever their number. Runs at once."""
    h = [F.shiftrightunsigned((F.col("kmer") * mix).bitwiseAND(0xFFFFFFFF), 32 - K.FOLD) for mix in K.MIXES]
    told = some.select(F.explode(F.array(*h)).alias("h")).groupBy(F.expr("h div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits"))
    bits = np.zeros((1 << K.FOLD) // 8, np.uint8)
    for part, some_bits in told.collect():
        bits[part * 4096 : part * 4096 + len(some_bits)] = np.frombuffer(some_bits, np.uint8)
    return bits


def kmer_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def usable_kmers(counts: DataFrame, max_hits: int) -> DataFrame:
    """K-mers that are frequent enough to exist and rare enough to help."""
    return counts.where(F.col("n") <= max_hits)


def _count_blocks(sequences: DataFrame, word_len: int, skip: int) -> DataFrame:
    """(range, size, keys, ns): blocks of sorted k-mers with their numbers."""
    ship(sequences.sparkSession)
    return chunks(sequences, "seq_id", PIECE, word_len - 1).mapInArrow(lambda batches: K.partial_counts(batches, word_len, skip, PIECE), "range int, size int, keys binary, ns binary")


def _counted(blocks: DataFrame, word_len: int) -> DataFrame:
    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(lambda batches: K.merged_counts(batches, word_len), "kmer bigint, n bigint, range int, inside bigint")


def count_kmers(sequences: DataFrame, word_len: int = 15, skip: int = 1) -> DataFrame:
    """(kmer, n): how often every k-mer of the sequences occurs. Blocks of sorted k-mers meet by range; no k-mer crosses a shuffle as a row."""
    return _counted(_count_blocks(sequences, word_len, skip), word_len).select("kmer", "n")


def prefix_sums(sequences: DataFrame, word_len: int = 15, skip: int = 1) -> DataFrame:
    """(kmer, n, first): where each k-mer's positions start in a list sorted by k-mer.

    Runs over ranges of k-mers and then over their totals, so that no task sees all k-mers.
    """
    blocks = _count_blocks(sequences, word_len, skip)
    totals = _counted(blocks, word_len).groupBy("range").agg(F.sum("n").alias("_t"))
    before = totals.select("range", F.coalesce(F.sum("_t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return _counted(blocks, word_len).join(F.broadcast(before), "range").select("kmer", "n", (F.col("_before") + F.col("inside")).alias("first"))


def sample_positions(sequences: DataFrame, max_hits: int, word_len: int = 15, skip: int = 1) -> DataFrame:
    """(kmer, seq_id, pos): exactly max_hits positions of every k-mer that has more, chosen by a hash of k-mer, sequence and position; all of the others.

    What has few positions stays where it is. Of a k-mer with n positions only hashes
    below a share of n are ranked, so many that fewer than max_hits of them
    have a chance of 2e-16 a k-mer (Chernoff); that would raise an error.
    """
    enough = max_hits + 36 + (36**2 + 72 * max_hits) ** 0.5
    kind = sequences.schema["seq_id"].dataType.simpleString()

    def part(frequent: bool):
        def use(t, row, pos, key, n):
            on = np.flatnonzero((n > max_hits) == frequent)
            cols = [pa.array(key[on].astype(np.int64)), t.column("seq_id").combine_chunks().take(pa.array(row[on])), pa.array(pos[on].astype(np.int32)), pa.array(n[on])]
            return pa.Table.from_arrays(cols, ["kmer", "seq_id", "pos", "n"])

        return use

    few, many = _asked(sequences, word_len, skip, (part(False), part(True)), f"kmer bigint, seq_id {kind}, pos int, n bigint")
    hashed = many.withColumn("_h", F.unhex(F.md5(F.concat_ws(":", "kmer", "seq_id", "pos"))))
    low = hashed.where(F.conv(F.hex(F.substring("_h", 1, 4)), 16, 10).cast("double") < F.lit(2.0**32 * enough) / F.col("n")).drop("n")
    ranked = low.withColumn("_r", F.row_number().over(Window.partitionBy("kmer").orderBy("_h"))).where(F.col("_r") <= max_hits)
    whole = ranked.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("kmer"))).where(F.when(F.col("_k") == max_hits, True).otherwise(F.raise_error(F.lit("too few hashes below the share")).cast("boolean")))
    return few.drop("n").unionByName(whole.select("kmer", "seq_id", "pos"))


def build_index(sequences: DataFrame, p: AlignParams) -> DataFrame:
    """(kmer, seq_id, pos) with at most index_max_hits positions per k-mer."""
    return sample_positions(sequences, p.index_max_hits, p.word_len, p.skip_dist)


def histogram(counts: DataFrame) -> DataFrame:
    """(n, kmers, hits): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("hits"))


def percentiles(counts: DataFrame, at: tuple[float, ...] = (25, 50, 75, 90, 95, 99, 99.9, 99.99)) -> DataFrame:
    """(percent, by_kmer, by_hit): the least count that covers that percentage of k-mers, and of positions. The histogram it runs over has a row per distinct count."""
    h = histogram(counts)
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = h.select("n", F.sum("kmers").over(upto).alias("k"), F.sum("hits").over(upto).alias("m"))
    total = h.agg(F.sum("kmers").alias("tk"), F.sum("hits").alias("tm"))
    wanted = run.crossJoin(F.broadcast(total)).select("n", "k", "m", "tk", "tm", F.explode(F.array(*map(F.lit, map(float, at)))).alias("percent"))
    reach = lambda part, whole: F.min(F.when(F.col(part) * 100.0 >= F.col("percent") * F.col(whole), F.col("n")))
    return wanted.groupBy("percent").agg(reach("k", "tk").alias("by_kmer"), reach("m", "tm").alias("by_hit"))


def postings(sequences: DataFrame, word_len: int = 15, over: int = 0, span: int = 1_000_000) -> DataFrame:
    """(kmer, n, first, last) of k-mers with more than `over` positions: how many, and the least and greatest seq_id * span + pos."""
    ship(sequences.sparkSession)
    parts = chunks(sequences, "seq_id", PIECE, word_len - 1).mapInArrow(lambda b: K.partial_places(b, word_len, span, PIECE), "range int, size int, keys binary, ns binary, ids binary, at binary, reach binary, base bigint")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: K.merged_places(b, word_len, span, over), "kmer bigint, n bigint, first bigint, last bigint")


def _asked(sequences: DataFrame, word_len: int, skip: int, uses: tuple, kinds: str) -> list[DataFrame]:
    """For each of uses: use(table of chunks, row, pos, key, n) over buckets of chunks, n being how often a window's k-mer occurs overall.

    A bucket, of some millions of bases, asks for its distinct k-mers by range; a
    range adds up what all buckets ask and answers each; a bucket finds its
    answers in the order of its sorted k-mers. Counts the bases at once, to
    know how many buckets there are.
    """
    ship(sequences.sparkSession)
    bases = sequences.agg(F.sum(F.length("seq").cast("bigint"))).first()[0] or 0
    cut = chunks(sequences, "seq_id", PIECE, word_len - 1).withColumn("bucket", F.pmod(F.xxhash64("seq_id", "chunk_id"), F.lit(1 + bases // BUCKET)).cast("int"))
    asked = cut.groupBy("bucket").applyInArrow(lambda key, t: K.bucket_requests(key[0].as_py(), t, word_len, skip, PIECE), "bucket int, range int, size int, at int, keys binary, ns binary")
    answers = asked.groupBy("range").applyInArrow(lambda t: K.answered(t, word_len), "bucket int, at int, size int, totals binary")

    def counted(use):
        return lambda t, a: use(t.combine_chunks(), *K.bucket_counts(t, a, word_len, skip, PIECE))

    both = cut.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    return [both.applyInArrow(counted(use), kinds) for use in uses]


def position_counts(sequences: DataFrame, word_len: int = 15, skip: int = 1) -> DataFrame:
    """(seq_id, pos, n): how often the k-mer at each position occurs overall."""

    def use(t, row, pos, key, n):
        return pa.Table.from_arrays([t.column("seq_id").combine_chunks().take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(n)], ["seq_id", "pos", "n"])

    kind = sequences.schema["seq_id"].dataType.simpleString()
    return _asked(sequences, word_len, skip, (use,), f"seq_id {kind}, pos int, n bigint")[0]


def write_index(index: DataFrame, table: str, p: AlignParams, buckets: int = 64) -> None:
    """Save as a table bucketed and sorted by k-mer, so that joins on k-mer need not shuffle it; parameters become table properties."""
    index.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer", "seq_id", "pos").format("parquet").saveAsTable(table)
    spark = index.sparkSession
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('word_len'='{p.word_len}', 'skip_dist'='{p.skip_dist}', 'index_max_hits'='{p.index_max_hits}')")


def index_name(word_len: int, skip: int, max_hits: int) -> str:
    return f"X{word_len:02d}_{skip:02d}_{max_hits:05d}S"


def read_index(spark, table: str, p: AlignParams) -> tuple[DataFrame, AlignParams]:
    """The saved index, and the parameters as it restricts them: its word length holds, and the smaller of both hit limits."""
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if "word_len" not in props:
        raise ValueError(f"{table} is no k-mer index")
    return spark.table(table), p.with_(word_len=int(props["word_len"]), skip_dist=int(props["skip_dist"]), max_hits=min(p.max_hits, int(props["index_max_hits"])))


def holds(sequences: DataFrame, index: DataFrame, word_len: int) -> DataFrame:
    """For validation: does each index row's k-mer stand in its sequence at its position?"""
    joined = index.join(sequences, "seq_id")
    return joined.select((pack_kmer(F.substring("seq", F.col("pos") + 1, F.lit(word_len))) == F.col("kmer")).alias("holds"))
