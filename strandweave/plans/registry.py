"""Queries by name, with the DuckDB SQL that checks them.

Large intermediate tables, such as all k-mers of the reference, are reported
as sums per sequence or k-mer range over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import edits, intervals
from strandweave.functions import sequences as S
from strandweave.operators import index, offsets, output, seeds, select, stats
from strandweave.params import AlignParams
from strandweave.plans.engine import Stages, hits_without_index, plan
from strandweave.plans.fixtures import FIRST_JOINED, IUPAC_SQL, READS_SQL, SEQS_SQL, WITH_N_SQL, kmers_sql, letters_as_iupac, reads, sequences, sequences_with_n
from strandweave.sources.text import validity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P = AlignParams()
NO_COVERAGE = P.with_(optimal_coverage=False)
SAMPLE = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _spread(df: DataFrame) -> DataFrame:
    """A small file is one task; its sequences are dealt out before they grow into k-mers. Larger inputs have tasks enough and stay where they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, df.columns[0])


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(sequences(spark, sf_dir))


def _stages(spark: SparkSession, sf_dir: str, p: AlignParams = P, again: bool = False) -> Stages:
    return plan(reads(spark, sf_dir), _seqs(spark, sf_dir), p, again=again)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported alignments of all reads, with readable edits."""
    found = _stages(spark, sf_dir).selected
    return found.select("query_id", "strand", "seq_id", "psqo", "peqo", "sro", "ero", edits.ops_string(F.col("ops")).alias("edits"), "score", "matches", "mapq", "primary_ix", "n_primaries", "n_secondaries")


# Sequences


@query(f"WITH {SEQS_SQL} SELECT seq_id, length(seq) AS n, md5(seq) AS bases FROM seqs")
def encode_sequences(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("n"), F.md5("seq").alias("bases"))


@query(f"WITH {SEQS_SQL} SELECT seq_id, md5(translate(seq, 'ACGT', 'TGCA')) AS complement FROM seqs")
def complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.md5(S.complement(F.col("seq"))).alias("complement"))


@query(f"WITH {READS_SQL} SELECT query_id, strand, seq FROM stranded")
def revcomp_reads(spark, sf_dir):
    return seeds.both_strands(reads(spark, sf_dir))


@query("SELECT doc_id, md5(regexp_replace(translate(coalesce(text, ''), 'tcagnbdhkmrsvwxyuU', 'TCAGNBDHKMRSVWXYTT'), '[^TCAGNBDHKMRSVWXY]', 'X', 'g')) AS bases FROM documents")
def normalise_bases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(S.normalise(F.coalesce("text", F.lit("")))).alias("bases"))


@query(f"WITH {READS_SQL}, seqs AS (SELECT query_id AS seq_id, seq FROM stranded WHERE strand = '+'), {kmers_sql()} SELECT t.seq_id AS query_id, k.pos, k.kmer, t.k AS text FROM kmers k JOIN kmer_text t ON t.seq_id = k.seq_id AND t.pos = k.pos")
def kmer_pack(spark, sf_dir):
    """Every k-mer of every read as a number and, unpacked again, as text."""
    k = index.kmers(reads(spark, sf_dir), P.word_len, 1, "query_id")
    return k.select("query_id", "pos", "kmer", S.unpack_kmer(F.col("kmer"), P.word_len).alias("text"))


@query(f"SELECT doc_id, md5(reverse(translate({IUPAC_SQL}, 'ACGTRYMKVBDH', 'TGCAYRKMBVHD'))) AS bases FROM documents")
def revcomp_iupac(spark, sf_dir):
    """Reverse complements of sequences with all letters of the code."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(S.reverse_complement(letters_as_iupac(F.coalesce("text", F.lit(""))))).alias("bases"))


# The index


def _per_sequence(k: DataFrame) -> DataFrame:
    return k.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"), F.sum("kmer").alias("kmers"))


_PER_SEQUENCE = "SELECT seq_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions, CAST(sum(kmer) AS BIGINT) AS kmers FROM kmers GROUP BY seq_id"


def _explode(skip: int) -> None:
    def kmer_explode(spark, sf_dir):
        return _per_sequence(index.kmers(_seqs(spark, sf_dir), P.word_len, skip))

    kmer_explode.__name__ = f"kmer_explode_skip{skip}"
    query(f"WITH {SEQS_SQL}, {kmers_sql(15, skip)} {_PER_SEQUENCE}")(kmer_explode)


for _skip in (1, 3, 15):
    _explode(_skip)


@query(f"WITH {SEQS_SQL}, {kmers_sql()} {_PER_SEQUENCE}".replace(SEQS_SQL, f"seqs AS (SELECT doc_id AS seq_id, {WITH_N_SQL} AS seq FROM documents)").replace("FROM kmer_text)", "FROM kmer_text WHERE NOT contains(k, 'N'))"))
def kmer_explode_with_n(spark, sf_dir):
    """Windows with a letter that is no base have no k-mer."""
    return _per_sequence(index.kmers(_spread(sequences_with_n(spark, sf_dir)), P.word_len))


def _counts(spark, sf_dir):
    return index.count_kmers(_seqs(spark, sf_dir), P.word_len)


_COUNTS = f"WITH {SEQS_SQL}, {kmers_sql()}, counts AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer)"


@query(f"{_COUNTS} SELECT kmer // 262144 AS prefix, count(*) AS kmers, CAST(sum(n) AS BIGINT) AS hits, CAST(sum(n * (kmer % 1009)) AS BIGINT) AS mark FROM counts GROUP BY ALL")
def kmer_counts(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return c.groupBy(F.expr("kmer div 262144").alias("prefix")).agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("hits"), F.sum(F.expr("n * (kmer % 1009)")).alias("mark"))


@query(f"{_COUNTS}, sums AS (SELECT kmer, sum(n) OVER (ORDER BY kmer) - n AS first FROM counts) SELECT kmer // 262144 AS prefix, CAST(min(first) AS BIGINT) AS lowest, CAST(max(first) AS BIGINT) AS highest, CAST(sum(first) AS BIGINT) AS total FROM sums GROUP BY ALL")
def kmer_prefix_sum(spark, sf_dir):
    sums = index.prefix_sums(_seqs(spark, sf_dir), P.word_len)
    return sums.groupBy(F.expr("kmer div 262144").alias("prefix")).agg(F.min("first").alias("lowest"), F.max("first").alias("highest"), F.sum("first").alias("total"))


@query(f"{_COUNTS} SELECT n, count(*) AS kmers, CAST(sum(n) AS BIGINT) AS hits FROM counts GROUP BY n")
def kmer_histogram(spark, sf_dir):
    return index.histogram(_counts(spark, sf_dir))


@query(f"""{_COUNTS}, h AS (SELECT n, count(*) AS c, sum(n) AS s FROM counts GROUP BY n),
run AS (SELECT n, sum(c) OVER (ORDER BY n) AS k, sum(s) OVER (ORDER BY n) AS m, sum(c) OVER () AS tk, sum(s) OVER () AS tm FROM h),
p AS (SELECT unnest([25.0, 50, 75, 90, 95, 99, 99.9, 99.99])::DOUBLE AS percent)
SELECT percent, min(n) FILTER (k * 100.0 >= percent * tk) AS by_kmer, min(n) FILTER (m * 100.0 >= percent * tm) AS by_hit FROM run, p GROUP BY percent""")
def kmer_percentiles(spark, sf_dir):
    return index.percentiles(_counts(spark, sf_dir))


@query(f"{_COUNTS} SELECT seq_id, count(*) AS n, CAST(sum(counts.n) AS BIGINT) AS total, max(counts.n) AS most FROM kmers JOIN counts USING (kmer) GROUP BY seq_id")
def kmer_refstats(spark, sf_dir):
    at = index.position_counts(_seqs(spark, sf_dir), P.word_len)
    return at.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query(f"WITH {SEQS_SQL}, {kmers_sql()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY md5(concat_ws(':', kmer, seq_id, pos))) AS r FROM kmers), kmers2 AS (SELECT * FROM ranked WHERE r <= {SAMPLE}) {_PER_SEQUENCE.replace('FROM kmers', 'FROM kmers2')}")
def kmer_sample_cap(spark, sf_dir):
    """An index that keeps a fixed number of positions of frequent k-mers: sampling is the feature."""
    return _per_sequence(index.build_index(_seqs(spark, sf_dir), P.with_(index_max_hits=SAMPLE)))


@query(f"{_COUNTS} SELECT kmer, n FROM counts WHERE n > {P.max_hits}")
def kmer_hot_filter(spark, sf_dir):
    return _counts(spark, sf_dir).where(F.col("n") > P.max_hits)


@query(f"{_COUNTS} SELECT kmer, count(*) AS n, min(seq_id * 1000000 + pos) AS first, max(seq_id * 1000000 + pos) AS last FROM kmers GROUP BY kmer HAVING count(*) > 20")
def kmer_postings(spark, sf_dir):
    """Where k-mers with many positions begin and end."""
    return index.postings(_seqs(spark, sf_dir), P.word_len, 20)


# Reads


@query(f"""WITH {READS_SQL}, given AS (SELECT query_id, seq FROM reads UNION ALL SELECT 5000000 + doc_id, {"seq"} FROM (SELECT doc_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents))
SELECT query_id, CASE WHEN length(seq) = 0 THEN 'empty' WHEN length(seq) > 32000 THEN 'too long' WHEN length(seq) < 15 THEN 'too short' END AS reason FROM given""")
def read_validity(spark, sf_dir):
    """Reads and whole documents as reads, with the reason why any is skipped."""
    docs = sequences(spark, sf_dir).select((F.col("seq_id") + 5_000_000).alias("query_id"), F.col("name").alias("qname"), "seq", F.lit(None).cast("string").alias("qual"))
    return validity(reads(spark, sf_dir).unionByName(docs), P).select("query_id", "reason")


@query(f"""WITH {SEQS_SQL} SELECT seq_id AS query_id, CASE WHEN length(seq) = 0 THEN 'empty' WHEN length(seq) > 32000 THEN 'too long' WHEN seq_id % 7 = 0 THEN 'quality length' WHEN length(seq) < 15 THEN 'too short' END AS reason FROM seqs""")
def read_validity_with_qualities(spark, sf_dir):
    """Documents as reads, every seventh with a quality that is one longer."""
    docs = sequences(spark, sf_dir).select(F.col("seq_id").alias("query_id"), F.col("name").alias("qname"), "seq", F.expr("repeat('I', length(seq) + if(seq_id % 7 = 0, 1, 0))").alias("qual"))
    return validity(docs, P).select("query_id", "reason")


@query("SELECT page_id, substr(replace(url || ' page ' || page_id, ' ', '_'), 1, 200) AS qname FROM pages")
def read_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", S.query_name(F.concat("url", F.lit(" page "), "page_id")).alias("qname"))


# Seeds


_HITS = f"""WITH {SEQS_SQL}, {READS_SQL}, {kmers_sql()},
read_text AS (SELECT query_id, strand, qo, substr(seq, CAST(qo + 1 AS BIGINT), 15) AS k FROM (SELECT query_id, strand, seq, unnest(range(0, length(seq) - 14)) AS qo FROM stranded)),
index_text AS (SELECT seq_id, pos, k FROM kmer_text),
rare AS (SELECT k FROM index_text GROUP BY k HAVING count(*) <= {P.max_hits}),
hits AS (SELECT query_id, strand, seq_id, CAST(pos - qo AS BIGINT) AS diag, CAST(qo AS INTEGER) AS qo FROM read_text JOIN rare USING (k) JOIN index_text USING (k))"""
_FRAGS = f"""{_HITS},
marked AS (SELECT *, coalesce(CAST(qo > lag(qo) OVER w + 15 AS INTEGER), 0) AS fresh FROM hits WINDOW w AS (PARTITION BY query_id, strand, seq_id, diag ORDER BY qo)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, strand, seq_id, diag ORDER BY qo) AS island FROM marked),
frags AS (SELECT query_id, strand, seq_id, diag, min(qo) AS sqo, CAST(max(qo) + 14 AS INTEGER) AS eqo, diag + min(qo) AS sro, CAST(max(qo) - min(qo) + 15 AS INTEGER) AS len FROM islands GROUP BY query_id, strand, seq_id, diag, island)"""
_REGIONS = f"""{_FRAGS},
jumps AS (SELECT *, coalesce(CAST(diag - lag(diag) OVER w > {P.max_gap} AS INTEGER), 0) AS fresh FROM frags WINDOW w AS (PARTITION BY query_id, strand, seq_id ORDER BY diag, sqo)),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY query_id, strand, seq_id ORDER BY diag, sqo ROWS UNBOUNDED PRECEDING) AS INTEGER) AS region FROM jumps),
regions AS (SELECT query_id, strand, seq_id, diag, sqo, eqo, sro, len, region, CAST(count(*) OVER (PARTITION BY query_id, strand, seq_id, region) AS INTEGER) AS n_frags FROM numbered)"""


def _hits(spark, sf_dir):
    return hits_without_index(seeds.both_strands(reads(spark, sf_dir)), _seqs(spark, sf_dir), P)


@query(f"{_HITS} SELECT * FROM hits")
def seed_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"{_FRAGS} SELECT * FROM frags")
def fragments(spark, sf_dir):
    return seeds.fragments(_hits(spark, sf_dir), P.word_len)


@query(f"{_REGIONS} SELECT * FROM regions")
def regions(spark, sf_dir):
    return seeds.regions(fragments(spark, sf_dir), P.max_gap)


@query(f"{_REGIONS} SELECT query_id, strand, seq_id, region, sqo, sro, len FROM regions WHERE n_frags = 1 AND len >= {P.min_match}")
def lone_clumps(spark, sf_dir):
    return seeds.lone_clumps(regions(spark, sf_dir), P.min_match).select("query_id", "strand", "seq_id", "region", "sqo", "sro", "len")


# Positions and scores


@query(f"WITH {SEQS_SQL}, o AS (SELECT seq_id, length(seq) AS n, sum(length(seq)) OVER (ORDER BY seq_id) - length(seq) AS start FROM seqs) SELECT a.seq_id AS of_seq, b.seq_id, CAST(a.start + a.n // 2 - b.start AS BIGINT) AS pos FROM o a JOIN o b ON a.start + a.n // 2 >= b.start AND a.start + a.n // 2 < b.start + b.n")
def offset_lookup(spark, sf_dir):
    """The middle of every sequence on the line of all sequences, found back."""
    o = offsets.sequence_offsets(_seqs(spark, sf_dir))
    middles = o.select(F.col("seq_id").alias("of_seq"), F.expr("start + length div 2").alias("offset"))
    return offsets.locate(middles, o).select("of_seq", "seq_id", "pos")


_PAIRS = f"{_FRAGS}, pairs AS (SELECT *, lead(sqo) OVER w AS sqo2, lead(eqo) OVER w AS eqo2, lead(sro) OVER w AS sro2, lead(seq_id) OVER w AS seq2 FROM frags WINDOW w AS (PARTITION BY query_id, strand ORDER BY sqo, diag, seq_id)), lens AS (SELECT query_id, length(seq) AS qlen FROM reads)"


@query(f"""{_PAIRS} SELECT query_id, strand, seq_id, diag, sqo, greatest(sqo2 - eqo - 1, 0) AS query_gap, greatest(eqo - sqo2 + 1, 0) AS query_overlap,
CASE WHEN strand = '-' THEN qlen - 1 - eqo ELSE sqo END AS plus_sqo, CASE WHEN strand = '-' THEN qlen - 1 - sqo ELSE eqo END AS plus_eqo,
CASE WHEN greatest(sqo2 - eqo - 1, 0) > 0 THEN -(5 + 2 * greatest(sqo2 - eqo - 1, 0)) ELSE 0 END AS cost,
CAST(CASE WHEN seq_id <> seq2 THEN 25 WHEN abs(sro2 - sro) <= 10 THEN 5 ELSE floor(least(log10(abs(sro2 - sro)), 5) * 5 + 0.5) END AS INTEGER) AS penalty FROM pairs JOIN lens USING (query_id) WHERE sqo2 IS NOT NULL""")
def interval_functions(spark, sf_dir):
    """Gaps, overlaps, read-direction positions and breakpoint penalties of fragments that follow each other on a read."""
    from pyspark.sql import Window

    on = Window.partitionBy("query_id", "strand").orderBy("sqo", "diag", "seq_id")
    f = fragments(spark, sf_dir).withColumns({c + "2": F.lead(c).over(on) for c in ("sqo", "eqo", "sro", "seq_id")}).where("sqo2 is not null")
    f = f.join(reads(spark, sf_dir).select("query_id", F.length("seq").alias("qlen")), "query_id")
    gap = intervals.gap_between(F.col("eqo"), F.col("sqo2"))
    place = (F.col("strand"), F.col("sqo"), F.col("eqo"), F.col("qlen"))
    return f.select(
        "query_id", "strand", "seq_id", "diag", "sqo", gap.alias("query_gap"), intervals.overlap_between(F.col("eqo"), F.col("sqo2")).alias("query_overlap"),
        intervals.plus_start(*place).alias("plus_sqo"), intervals.plus_end(*place).alias("plus_eqo"), intervals.gap_cost(gap, P).alias("cost"),
        intervals.breakpoint_penalty(F.col("seq_id") == F.col("seq_id2"), F.abs(F.col("sro2") - F.col("sro")), P).alias("penalty"),
    )


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 3 = 0 THEN 250 ELSE floor(250.0 * (greatest(a - b, 0) / a) * (1 + CASE WHEN o_custkey % 3 = 1 THEN 1.0 ELSE greatest(a - c, 0) / a END) / 2 + 0.5) END AS INTEGER) AS mapq FROM (SELECT o_orderkey, o_custkey, CAST(25 + o_orderkey % 300 AS DOUBLE) AS a, CAST(25 + o_custkey % 280 AS DOUBLE) AS b, CAST(25 + o_custkey % 90 AS DOUBLE) AS c FROM orders)")
def mapping_qualities(spark, sf_dir):
    """Mapping quality over scores made of order keys, with none, one or two competitors."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    third = F.col("o_custkey") % 3
    a, b, c = (25 + F.col(k) % n for k, n in (("o_orderkey", 300), ("o_custkey", 280), ("o_custkey", 90)))
    return o.select("o_orderkey", intervals.mapping_quality(a, F.when(third > 0, b), F.when(third > 1, c)).alias("mapq"))


_OPS = "ops AS (SELECT l_orderkey AS id, l_linenumber AS line, ['M', 'R', 'I', 'D'][CAST(l_partkey % 4 AS INTEGER) + 1] AS op, CAST(1 + l_suppkey % 60 AS INTEGER) AS len FROM lineitem)"


def _edit_table(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    op = F.element_at(F.array(*map(F.lit, "MRID")), (F.col("l_partkey") % 4 + 1).cast("int"))
    one = F.struct(F.col("l_linenumber").alias("at"), op.alias("op"), (1 + F.col("l_suppkey") % 60).cast("int").alias("len"))
    told = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("o"))
    return told.select("id", F.transform("o", lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"))).alias("ops"))


@query(f"""WITH {_OPS}, scored AS (SELECT *, CASE op WHEN 'M' THEN len WHEN 'R' THEN -3 * len ELSE -(5 + 2 * len) END AS s FROM ops),
run AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY line, op, len ROWS UNBOUNDED PRECEDING) AS total FROM scored)
SELECT id, CAST(sum(s) AS INTEGER) AS score, CAST(min(total) AS INTEGER) AS low, CAST(max(total) AS INTEGER) AS high, CAST(coalesce(sum(len) FILTER (op = 'M'), 0) AS INTEGER) AS matches,
CAST(coalesce(sum(len) FILTER (op <> 'M'), 0) AS INTEGER) AS nm, CAST(sum(len) AS INTEGER) AS aln_len, CAST(coalesce(sum(len) FILTER (op <> 'D'), 0) AS INTEGER) AS query_len,
bool_or(op = 'M' AND len >= 15) AS anchored FROM run GROUP BY id""")
def edit_scores(spark, sf_dir):
    """Scores, prefix extremes and lengths of edit lists made of order lines."""
    e, o = _edit_table(spark, sf_dir), F.col("ops")
    x = edits.prefix_extremes(o, P)
    return e.select("id", edits.edit_score(o, P).alias("score"), x["low"].alias("low"), x["high"].alias("high"), edits.matches(o).alias("matches"), edits.edit_distance(o).alias("nm"), edits.alignment_length(o).alias("aln_len"), edits.query_length(o).alias("query_len"), edits.has_match_run(o, 15).alias("anchored"))


@query(f"""WITH {_OPS}, plain AS (SELECT id, line, op AS raw, len, CASE WHEN op = 'R' THEN 'M' ELSE op END AS op FROM ops),
marked AS (SELECT *, coalesce(CAST(op <> lag(op) OVER w AS INTEGER), 0) AS fresh FROM plain WINDOW w AS (PARTITION BY id ORDER BY line, raw, len)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY line, raw, len ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (SELECT id, run, min(op) AS op, sum(len) AS len FROM runs GROUP BY id, run)
SELECT id, CASE WHEN id % 5 > 0 THEN (id % 5) || 'S' ELSE '' END || string_agg(len || op, '' ORDER BY run) || CASE WHEN id % 7 > 0 THEN (id % 7) || 'S' ELSE '' END AS cigar FROM merged GROUP BY id""")
def cigars(spark, sf_dir):
    e = _edit_table(spark, sf_dir)
    return e.select("id", edits.cigar(F.col("ops"), (F.col("id") % 5).cast("int"), (F.col("id") % 7).cast("int"), "S").alias("cigar"))


@query(f"""WITH {_OPS}, scored AS (SELECT id, CASE op WHEN 'M' THEN len WHEN 'R' THEN -3 * len ELSE -(5 + 2 * len) END AS s, row_number() OVER (PARTITION BY id ORDER BY line, op, len) AS n FROM ops),
spans AS (SELECT a.id, (SELECT sum(s) FROM scored c WHERE c.id = a.id AND c.n BETWEEN a.n AND b.n) AS total FROM scored a JOIN scored b ON a.id = b.id AND a.n <= b.n)
SELECT id, CAST(greatest(max(total), 0) AS INTEGER) AS best FROM spans GROUP BY id""")
def best_cores(spark, sf_dir):
    """The best-scoring run of edits: where a bad alignment is split."""
    return _edit_table(spark, sf_dir).select("id", edits.best_core(F.col("ops"), P).alias("best"))


_ALNS = """alns AS (SELECT l_orderkey AS query_id, ['+', '-'][CAST(l_partkey % 2 AS INTEGER) + 1] AS strand, l_suppkey % 3 AS seq_id, CAST((l_partkey % 4) * 10 AS INTEGER) AS sqo, CAST((l_partkey % 4) * 10 + 60 + (l_suppkey % 3) * 20 AS INTEGER) AS eqo,
(l_partkey % 2) * 500 AS sro, (l_partkey % 2) * 500 + 80 AS ero, CAST(30 + l_suppkey % 70 AS INTEGER) AS score, CAST(l_linenumber AS INTEGER) AS line, 200 AS query_len FROM lineitem)"""


def _alignment_table(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.selectExpr(
        "l_orderkey as query_id", "element_at(array('+', '-'), cast(l_partkey % 2 as int) + 1) as strand", "l_suppkey % 3 as seq_id", "cast((l_partkey % 4) * 10 as int) as sqo", "cast((l_partkey % 4) * 10 + 60 + (l_suppkey % 3) * 20 as int) as eqo",
        "(l_partkey % 2) * 500 as sro", "(l_partkey % 2) * 500 + 80 as ero", "cast(30 + l_suppkey % 70 as int) as score", "cast(l_linenumber as int) as line", "200 as query_len",
        "array(named_struct('op', 'M', 'len', cast(30 + l_suppkey % 70 as int))) as ops", "255 as mapq", "12 as status",
    )


@query(f"WITH {_ALNS} SELECT query_id, strand, seq_id, sqo, eqo, sro, ero, max(score) AS score FROM alns GROUP BY ALL")
def dedupe_alignments(spark, sf_dir):
    return select.best_of_duplicates(_alignment_table(spark, sf_dir)).select("query_id", "strand", "seq_id", "sqo", "eqo", "sro", "ero", "score")


_SIMILAR = f"""WITH {_ALNS}, plus AS (SELECT *, CASE WHEN strand = '-' THEN query_len - 1 - eqo ELSE sqo END AS psqo, CASE WHEN strand = '-' THEN query_len - 1 - sqo ELSE eqo END AS peqo FROM (SELECT DISTINCT ON (query_id, strand, seq_id, sqo, eqo, sro, ero) * FROM alns ORDER BY score DESC)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY psqo, peqo, strand, seq_id, sro, score) AS r FROM plus),
heads AS (SELECT * FROM ranked WHERE r % 3 = 1), rest AS (SELECT * FROM ranked WHERE r % 3 <> 1),
tied AS (SELECT a.query_id, a.r, h.r AS hr, a.score, h.score AS hs, greatest(least(a.peqo, h.peqo) - greatest(a.psqo, h.psqo) + 1, 0) AS o, a.peqo - a.psqo + 1 AS la, h.peqo - h.psqo + 1 AS lh FROM rest a JOIN heads h USING (query_id)),
best AS (SELECT * FROM tied QUALIFY row_number() OVER (PARTITION BY query_id, r ORDER BY o DESC, hr) = 1),
rivals AS (SELECT query_id, hr, list_sort(list(score), 'DESC') AS s, sum(CAST(score >= 0.9 * hs AND o >= 0.9 * la AND o >= 0.9 * lh AS INTEGER)) AS n FROM best GROUP BY ALL)
SELECT h.query_id, CAST(h.r AS INTEGER) AS primary_ix, h.score, CAST(CASE WHEN s IS NULL THEN 250 ELSE floor(250.0 * (greatest(h.score - s[1], 0)::DOUBLE / h.score) * (1 + CASE WHEN s[2] IS NULL THEN 1.0 ELSE greatest(h.score - s[2], 0)::DOUBLE / h.score END) / 2 + 0.5) END AS INTEGER) AS mapq,
CAST(coalesce(n, 0) AS INTEGER) AS n_secondaries FROM heads h LEFT JOIN rivals v ON v.query_id = h.query_id AND v.hr = h.r"""


@query(_SIMILAR)
def similar_alignments(spark, sf_dir):
    """Competitors, mapping quality and number of near-equal alternatives of given primaries."""
    from pyspark.sql import Window

    a = select.best_of_duplicates(_alignment_table(spark, sf_dir))
    place = (F.col("strand"), F.col("sqo"), F.col("eqo"), F.col("query_len"))
    a = a.withColumns({"psqo": intervals.plus_start(*place), "peqo": intervals.plus_end(*place)})
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("psqo", "peqo", "strand", "seq_id", "sro", "score"))
    a = a.withColumn("primary_ix", r).withColumn("primary_ix", F.when(F.col("primary_ix") % 3 == 1, F.col("primary_ix"))).withColumn("n_primaries", F.lit(1))
    return select.similar(a, P).select("query_id", "primary_ix", "score", "mapq", "n_secondaries")


_MADE = """made AS (SELECT query_id, strand, seq_id, sqo, eqo, sro, ero, score, line, 'read' || query_id AS qname, 'ref' || seq_id AS rname, score AS matches, score + line AS aln_len, line - 1 AS mismatches, 1 AS gap_bases,
CASE WHEN strand = '-' THEN 199 - eqo ELSE sqo END AS psqo, CASE WHEN strand = '-' THEN 199 - sqo ELSE eqo END AS peqo, left(repeat(translate(md5(CAST(query_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 7), 200) AS seq FROM alns)"""


def _made_results(spark, sf_dir):
    """Selected alignments made of order lines, with their reads and sequences."""
    from pyspark.sql import Window

    a = _alignment_table(spark, sf_dir)
    place = (F.col("strand"), F.col("sqo"), F.col("eqo"), F.col("query_len"))
    a = a.withColumns({"psqo": intervals.plus_start(*place), "peqo": intervals.plus_end(*place), "matches": F.col("score"), "aln_len": F.expr("score + line"), "mismatches": F.expr("line - 1"), "gap_bases": F.lit(1)})
    a = a.withColumns({"ref": F.expr("repeat('A', score)"), "matched_primary": F.expr("if(line % 2 = 0, line, null)"), "n_primaries": F.expr("if(line % 3 = 0, line, null)"), "n_secondaries": F.expr("if(line % 3 = 1, line, null)")})
    each = a.select("query_id").distinct()
    seq = F.substring(F.repeat(F.translate(F.md5(F.col("query_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN"), 7), 1, 200)
    given = each.select("query_id", F.concat(F.lit("read"), "query_id").alias("qname"), seq.alias("seq"), F.when(F.col("query_id") % 2 == 0, F.expr("repeat(chr(cast(40 + query_id % 50 as int)), 200)")).alias("qual"))
    refs = spark.range(3).select(F.col("id").alias("seq_id"), F.concat(F.lit("ref"), "id").alias("name"))
    return a, given, refs


@query(f"""WITH {_ALNS}, {_MADE} SELECT qname, rname, round(100.0 * matches / aln_len, 2)::DOUBLE AS identity, aln_len, mismatches, gap_bases, psqo + 1 AS qstart, peqo + 1 AS qend,
CASE WHEN strand = '-' THEN ero + 1 ELSE sro + 1 END AS rstart, CASE WHEN strand = '-' THEN sro + 1 ELSE ero + 1 END AS rend, strand, score, 200 AS query_len, round(100.0 * matches / 200, 2)::DOUBLE AS coverage FROM made""")
def report_rows_made(spark, sf_dir):
    """The report of given alignments."""
    return output.report_rows(*_made_results(spark, sf_dir))


@query(f"""WITH {_ALNS}, {_MADE}, told AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS shown FROM made)
SELECT query_id, qname, CASE WHEN strand = '-' THEN 16 ELSE 0 END AS flag, rname, sro + 1 AS pos, 255 AS mapq,
CASE WHEN sqo > 0 THEN sqo || 'S' ELSE '' END || score || 'M' || CASE WHEN 199 - eqo > 0 THEN (199 - eqo) || 'S' ELSE '' END AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen, shown AS seq,
CASE WHEN query_id % 2 = 0 THEN repeat(chr(CAST(40 + query_id % 50 AS INTEGER)), 200) ELSE '*' END AS qual,
'AS:i:' || score || chr(9) || 'NM:i:0' || chr(9) || 'MD:Z:' || score || chr(9) || 'YF:Z:0c' || CASE WHEN line % 2 = 0 THEN chr(9) || 'YI:i:' || line ELSE '' END || CASE WHEN line % 3 = 0 THEN chr(9) || 'YP:i:' || line ELSE '' END || CASE WHEN line % 3 = 1 THEN chr(9) || 'YS:i:' || line ELSE '' END AS tags FROM told""")
def sam_rows_made(spark, sf_dir):
    """The SAM records of given alignments, with soft clips."""
    return output.sam_rows(*_made_results(spark, sf_dir), P, "S")


# Whole alignments


@query(f"WITH {SEQS_SQL}, {READS_SQL} SELECT DISTINCT r.query_id, s.seq_id, length(r.seq) AS score FROM reads r JOIN seqs s ON contains(s.seq, r.seq)")
def exact_read_alignments(spark, sf_dir):
    """Reads that stand in a sequence as they are: one run of matches from end to end."""
    found = _stages(spark, sf_dir, NO_COVERAGE).alignments
    whole = (F.col("strand") == "+") & (F.size("ops") == 1) & (F.col("matches") == F.col("query_len"))
    return found.where(whole).select("query_id", "seq_id", "score").distinct()


def _changed(change: str, edits_are: str) -> str:
    """SQL: items that stand in a sequence as they are, with one base of the middle changed."""
    return f"WITH {SEQS_SQL}, {READS_SQL} SELECT DISTINCT r.query_id, s.seq_id, CAST({edits_are} AS INTEGER) AS score FROM reads r JOIN seqs s ON contains(s.seq, r.seq) WHERE r.query_id < {FIRST_JOINED} AND NOT contains(s.seq, {change}) AND length(r.seq) >= 60"


def _changed_alignments(spark, sf_dir, change: str, kept: str):
    """Alignments over the whole changed read in one piece, on the strand of the item."""
    given = reads(spark, sf_dir).where(F.col("query_id") < FIRST_JOINED).where("length(seq) >= 60").withColumn("seq", F.expr(change))
    found = plan(given, _seqs(spark, sf_dir), NO_COVERAGE).alignments
    whole = F.expr(f"strand = '+' and sqo = 0 and eqo = query_len - 1 and {kept}")
    return found.where(whole).select("query_id", "seq_id", "score").distinct()


@query(_changed("left(r.seq, length(r.seq) // 2) || translate(substr(r.seq, length(r.seq) // 2 + 1, 1), 'ACGT', 'CATG') || substr(r.seq, length(r.seq) // 2 + 2)", "length(r.seq) - 1 - 3"))
def replaced_base_alignments(spark, sf_dir):
    """Items with the middle base replaced: one replacement, at that place."""
    change = "concat(left(seq, length(seq) div 2), translate(substring(seq, cast(length(seq) div 2 + 1 as int), 1), 'ACGT', 'CATG'), substring(seq, cast(length(seq) div 2 + 2 as int)))"
    return _changed_alignments(spark, sf_dir, change, "size(ops) = 3 and ops[1].op = 'R' and ops[1].len = 1 and ops[0].len = query_len div 2")


@query(_changed("left(r.seq, length(r.seq) // 2) || substr(r.seq, length(r.seq) // 2 + 2)", "length(r.seq) - 1 - 7"))
def dropped_base_alignments(spark, sf_dir):
    """Items without the middle base: one gap of one base."""
    change = "concat(left(seq, length(seq) div 2), substring(seq, cast(length(seq) div 2 + 2 as int)))"
    return _changed_alignments(spark, sf_dir, change, "size(ops) = 3 and ops[1].op = 'D' and ops[1].len = 1")


@query(f"WITH {SEQS_SQL}, {READS_SQL} SELECT r.query_id, length(r.seq) AS query_len FROM reads r WHERE EXISTS (SELECT 1 FROM seqs s WHERE contains(s.seq, r.seq))")
def fully_covered_reads(spark, sf_dir):
    """Reads that one primary alignment covers from end to end without an error."""
    found = _stages(spark, sf_dir).selected
    return found.where((F.col("n_primaries") == 1) & (F.col("matches") == F.col("query_len")) & (F.size("ops") == 1)).select("query_id", F.col("query_len").cast("bigint").alias("query_len")).distinct()


@query()
def chain_clumps(spark, sf_dir):
    c = _stages(spark, sf_dir).clumps
    return c.select("query_id", "strand", "seq_id", "region", "clump", F.array_join(F.transform("frags", lambda f: F.concat_ws(":", f["sqo"], f["sro"], f["len"])), ",").alias("frags"))


@query()
def all_alignments(spark, sf_dir):
    """Every sound alignment once: no coverage selection."""
    a = _stages(spark, sf_dir, NO_COVERAGE).selected
    return a.select("query_id", "strand", "seq_id", "sqo", "eqo", "sro", "ero", edits.ops_string(F.col("ops")).alias("edits"), "score", "status")


@query()
def coverage_primaries(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def coverage_with_similar(spark, sf_dir):
    a = _stages(spark, sf_dir, P.with_(similar=True)).selected
    return a.select("query_id", "strand", "seq_id", "psqo", "peqo", "sro", "ero", "score", "mapq", "primary_ix", "matched_primary", "n_secondaries")


@query()
def sam_rows(spark, sf_dir):
    return output.sam_rows(_stages(spark, sf_dir).selected, reads(spark, sf_dir), sequences(spark, sf_dir), P)


@query()
def report_rows(spark, sf_dir):
    return output.report_rows(_stages(spark, sf_dir).selected, reads(spark, sf_dir), sequences(spark, sf_dir))


@query(f"WITH {SEQS_SQL} SELECT seq_id AS n, '@SQ' || chr(9) || 'SN:doc' || seq_id || chr(9) || 'LN:' || length(seq) AS line FROM seqs")
def sam_sequence_lines(spark, sf_dir):
    return output.sam_header(sequences(spark, sf_dir), P).where("line like '@SQ%'")


@query(f"""{_REGIONS}, s AS (SELECT query_id, count(*) AS n FROM hits GROUP BY ALL), g AS (SELECT query_id, count(DISTINCT (strand, seq_id, region)) AS n, count(*) AS f FROM regions GROUP BY query_id)
SELECT r.query_id, length(r.seq) AS query_len, coalesce(s.n, 0) AS n_seeds, coalesce(g.n, 0) AS n_regions, coalesce(g.f, 0) AS n_fragments FROM reads r LEFT JOIN s USING (query_id) LEFT JOIN g USING (query_id)""")
def read_seed_stats(spark, sf_dir):
    """Statistics of reads before alignment."""
    s = _stages(spark, sf_dir, again=True)
    return stats.seed_stats(reads(spark, sf_dir), s.hits, s.regions)


@query()
def read_stats(spark, sf_dir):
    s = _stages(spark, sf_dir, again=True)
    return stats.query_stats(reads(spark, sf_dir), s.hits, s.regions, s.alignments, s.selected)


@query()
def run_stats(spark, sf_dir):
    return stats.run_stats(read_stats(spark, sf_dir))


@query()
def unaligned_reads(spark, sf_dir):
    return stats.unaligned_reads(reads(spark, sf_dir), _stages(spark, sf_dir).selected).select("query_id", "qname")
