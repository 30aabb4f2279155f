"""From clumps to alignments: fill gaps, extend ends, score, split, filter.

Runs over Arrow batches of clumps, each with its read and the reference
window around it. Windows are cut from chunks in the JVM, so that no task
holds a whole reference sequence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.chain import Frag, query_gap, ref_gap
from strandweave.operators.dp import align_between, edits_score, extend, joined, longest_match, op_score
from strandweave.operators.index import CHUNK, chunks
from strandweave.operators.seeds import GROUP
from strandweave.params import UNSET_MAPQ, AlignParams
from strandweave.session import ship

REVERSED, ALIGNED, SCORED, SPLIT, PRIMARY = 0x01, 0x04, 0x08, 0x10, 0x20
EDITS = "array<struct<op: string, len: int>>"
#: Sequences whose ids are sent to every executor, to read no others: some 32 MB.
FEW = 1 << 20
_EDITS = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))


class WindowTooSmall(RuntimeError):
    """An extension would have to look past the reference window, and not because the sequence ends there."""


@dataclass
class Site:
    """A read on one strand, and a window of one sequence."""

    read: bytes
    window: bytes
    first: int  # sequence position of the window's first base
    seq_len: int

    def ref(self, start: int, stop: int) -> bytes:
        a, b = start - self.first, stop - self.first
        if a < 0 or b > len(self.window):
            raise WindowTooSmall(f"bases {start} to {stop} of a window {self.first} to {self.first + len(self.window)}")
        return self.window[a:b]


@dataclass
class Alignment:
    """Edits that start at read position sqo and sequence position sro."""

    sqo: int
    sro: int
    ops: list = field(default_factory=list)
    split: bool = False

    @property
    def eqo(self) -> int:
        return self.sqo + sum(n for op, n in self.ops if op != "D") - 1

    @property
    def ero(self) -> int:
        return self.sro + sum(n for op, n in self.ops if op != "I") - 1

    def score(self, p: AlignParams) -> int:
        return edits_score(self.ops, p)


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def collapse(frags: list[Frag], site: Site, p: AlignParams) -> Alignment:
    """One alignment of a chain: neighbours grow towards each other over equal bases, and what stays between them is aligned."""
    parts = [f.copy() for f in frags]
    for a, b in zip(parts, parts[1:]):
        room = min(query_gap(a, b), ref_gap(a, b))
        back = _shared_prefix(site.read[b.sqo - room : b.sqo][::-1], site.ref(b.sro - room, b.sro)[::-1])
        b.sqo, b.sro, b.len = b.sqo - back, b.sro - back, b.len + back
        room -= back
        a.len += _shared_prefix(site.read[a.eqo + 1 : a.eqo + 1 + room], site.ref(a.ero + 1, a.ero + 1 + room))
    ops = [["M", parts[0].len]]
    for a, b in zip(parts, parts[1:]):
        between = align_between(site.read[a.eqo + 1 : b.sqo], site.ref(a.ero + 1, b.sro), p)
        ops = joined(ops, between, [["M", b.len]])
    return Alignment(parts[0].sqo, parts[0].sro, ops)


def _careful(ops: list, score: int, backward: bool, p: AlignParams) -> list:
    """As much of an extension as keeps every running total of the whole above 0.

    ops run away from the core. Forward, the total runs on from the core's
    score and the best end is kept if it would fall to 0. Backward, it runs
    from the far end towards the core, restarts where it falls to 0, and must
    stay a gain whose peak the core still tops.
    """
    if not backward:
        total, best, cut = score, score, 0
        for i, (op, n) in enumerate(ops):
            total += op_score(op, n, p)
            if total > best:
                best, cut = total, i + 1
            if total <= 0:
                return ops[:cut]
        return ops
    total = high = 0
    kept = len(ops)
    for i in range(len(ops) - 1, -1, -1):
        total += op_score(*ops[i], p)
        high = max(high, total)
        if total <= 0:
            total = high = 0
            kept = i
    return ops[:kept] if kept and total > 0 and high < total + score else []


def grow(aln: Alignment, site: Site, p: AlignParams, back: bool = True, forward: bool = True, careful: bool = False) -> None:
    """Extend over equal bases both ways, then by dynamic programming back and forward where enough is left."""
    if back:
        room = min(aln.sqo, aln.sro)
        n = _shared_prefix(site.read[aln.sqo - room : aln.sqo][::-1], site.ref(aln.sro - room, aln.sro)[::-1])
        aln.sqo, aln.sro, aln.ops = aln.sqo - n, aln.sro - n, joined([["M", n]], aln.ops)
    if forward:
        room = min(len(site.read) - 1 - aln.eqo, site.seq_len - 1 - aln.ero)
        n = _shared_prefix(site.read[aln.eqo + 1 : aln.eqo + 1 + room], site.ref(aln.ero + 1, aln.ero + 1 + room))
        aln.ops = joined(aln.ops, [["M", n]])
    for backward in (True, False):
        if not (back if backward else forward):
            continue
        queries = aln.sqo if backward else len(site.read) - 1 - aln.eqo
        refs = aln.sro if backward else site.seq_len - 1 - aln.ero
        if min(queries, refs) < p.min_extension:
            continue
        wanted = queries + 2 * p.band_width
        if wanted > refs:
            wanted, queries = refs, min(queries, refs - 2 * p.band_width)
        if queries <= 0:
            continue
        if backward:
            q, r = site.read[aln.sqo - queries : aln.sqo][::-1], site.ref(aln.sro - wanted, aln.sro)[::-1]
        else:
            q, r = site.read[aln.eqo + 1 : aln.eqo + 1 + queries], site.ref(aln.ero + 1, aln.ero + 1 + wanted)
        ops, gain = extend(q, r, p)
        if careful and gain > 0:
            ops = _careful(ops, aln.score(p), backward, p)
        if gain <= 0 or not ops:
            continue
        if backward:
            aln.sqo -= sum(n for op, n in ops if op != "D")
            aln.sro -= sum(n for op, n in ops if op != "I")
            aln.ops = joined(ops[::-1], aln.ops)
        else:
            aln.ops = joined(aln.ops, ops)


def needs_split(ops: list, p: AlignParams) -> bool:
    """Does a prefix score nothing, or more than the whole?"""
    whole, total = edits_score(ops, p), 0
    for i, (op, n) in enumerate(ops):
        total += op_score(op, n, p)
        if total <= 0 or i < len(ops) - 1 and total >= whole:
            return True
    return False


def good_enough(ops: list, p: AlignParams) -> bool:
    matched, length = sum(n for op, n in ops if op == "M"), sum(n for _, n in ops)
    return matched >= p.min_raw_score and matched >= p.min_identity * length - 1e-9


def core_of(ops: list, p: AlignParams) -> tuple[int, int]:
    """(first, last) op of the best-scoring run; the earliest end, the shortest such run."""
    here = best = 0
    last = -1
    for i, (op, n) in enumerate(ops):
        here = max(0, here + op_score(op, n, p))
        if here > best:
            best, last = here, i
    first, left = last, best
    while first >= 0:
        left -= op_score(*ops[first], p)
        if left <= 0:
            break
        first -= 1
    return max(first, 0), last


def settled(aln: Alignment, site: Site, p: AlignParams) -> list[Alignment]:
    """The alignment itself if it is sound, else the sound pieces it falls into; none if nothing passes."""
    if not needs_split(aln.ops, p):
        return [aln] if good_enough(aln.ops, p) else []
    return _pieces(aln, aln.sqo, aln.eqo, site, p)


def _pieces(aln: Alignment, first_q: int, last_q: int, site: Site, p: AlignParams) -> list[Alignment]:
    a, b = core_of(aln.ops, p)
    if b < 0 or longest_match(aln.ops[a : b + 1]) < p.word_len:
        return []
    out = []

    def part(lo: int, hi: int) -> Alignment:
        before = aln.ops[:lo]
        return Alignment(aln.sqo + sum(n for op, n in before if op != "D"), aln.sro + sum(n for op, n in before if op != "I"), [list(o) for o in aln.ops[lo:hi]], True)

    if longest_match(aln.ops[:a]) >= p.word_len:
        out += _pieces(part(0, a), first_q, last_q, site, p)
    core = part(a, b + 1)
    shrunk = len(core.ops) < len(aln.ops)
    grow(core, site, p, core.sqo != first_q, core.eqo != last_q, careful=True)
    if not needs_split(core.ops, p):
        out += [core] if good_enough(core.ops, p) else []
    elif shrunk:
        # an extension undid the split: the core alone is sound by construction
        bare = part(a, b + 1)
        out += [bare] if not needs_split(bare.ops, p) and good_enough(bare.ops, p) else []
    if longest_match(aln.ops[b + 1 :]) >= p.word_len:
        out += _pieces(part(b + 1, len(aln.ops)), first_q, last_q, site, p)
    return out


def align_clump(frags: list[Frag], site: Site, p: AlignParams) -> list[Alignment]:
    aln = collapse(frags, site, p)
    grow(aln, site, p)
    return settled(aln, site, p)


def those_with(clumps: DataFrame, sequences: DataFrame) -> DataFrame:
    """The sequences that have clumps; up to FEW of them leave the others where they are. Counts them at once."""
    ids = clumps.select("seq_id").distinct()
    few = ids.limit(FEW + 1).count() <= FEW
    return sequences.join(F.broadcast(ids) if few else ids, "seq_id", "left_semi")


def with_windows(clumps: DataFrame, sequences: DataFrame, reads: DataFrame, p: AlignParams) -> DataFrame:
    """Adds read (on the clump's strand), window, first and seq_len to clumps. A window that reaches past the sequence meets no chunk there."""
    pad = 8 * p.band_width + 2 * p.max_gap
    near = clumps.join(reads.select("query_id", "strand", F.col("seq").alias("read")), ["query_id", "strand"])
    low = F.array_min(F.transform("frags", lambda f: f["sro"] - f["sqo"])) - pad
    high = F.array_max(F.transform("frags", lambda f: f["sro"] - f["sqo"])) + F.length("read") + pad
    spans = near.withColumn("_lo", F.greatest(low, F.lit(0))).withColumn("_hi", high)
    key = [*GROUP, "region", "clump"]
    rest = ["frags", "read", "_lo", "_hi"]
    wanted = spans.select(*key, *rest, F.explode(F.sequence(F.expr(f"cast(_lo div {CHUNK} as int)"), F.expr(f"cast((_hi - 1) div {CHUNK} as int)"))).alias("chunk_id"))
    pieces = chunks(those_with(clumps, sequences).withColumn("seq_len", F.length("seq")), keep=("seq_len",))
    parts = wanted.join(pieces, ["seq_id", "chunk_id"])
    cut = parts.groupBy(*key).agg(*(F.first(c).alias(c) for c in (*rest, "seq_len")), F.array_sort(F.collect_list(F.struct("chunk_id", "bases"))).alias("c"))
    first = F.col("_lo") - F.expr(f"(_lo div {CHUNK}) * {CHUNK}")
    window = F.substring(F.array_join(F.transform("c", lambda x: x["bases"]), ""), (first + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
    return cut.select(*key, "frags", "read", window.alias("window"), F.col("_lo").alias("first"), "seq_len")


ALIGNMENT = f"sqo int, eqo int, sro bigint, ero bigint, ops {EDITS}, ref string, score int, matches int, mismatches int, gap_bases int, aln_len int, status int, query_len int, mapq int"


def align_clumps(clumps: DataFrame, sequences: DataFrame, reads: DataFrame, p: AlignParams) -> DataFrame:
    """(*GROUP, alignment columns): every sound alignment. reads has both strands; read positions are on the strand."""
    ship(clumps.sparkSession)
    ready = with_windows(clumps, sequences, reads, p)
    keys = list(GROUP)
    names = ["sqo", "eqo", "sro", "ero", "ops", "ref", "score", "matches", "mismatches", "gap_bases", "aln_len", "status", "query_len", "mapq"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), _EDITS, pa.string(), *[pa.int32()] * 8]

    def run(batches):
        for b in batches:
            at, rows = [], []
            cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("strand", "frags", "read", "window", "first", "seq_len"))
            for i, (strand, frags, read, window, first, seq_len) in enumerate(zip(*cols)):
                site = Site(read.encode(), window.encode(), first, seq_len)
                for a in align_clump([Frag(**f) for f in frags], site, p):
                    count = {k: sum(n for op, n in a.ops if op in k) for k in ("M", "R", "ID", "MRID")}
                    status = ALIGNED | SCORED | (REVERSED if strand == "-" else 0) | (SPLIT if a.split else 0)
                    at.append(i)
                    rows.append((a.sqo, a.eqo, a.sro, a.ero, [{"op": op, "len": n} for op, n in a.ops], site.ref(a.sro, a.ero + 1).decode(), a.score(p), *count.values(), status, len(read), UNSET_MAPQ))
            own = b.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds))], [*keys, *names])

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.select(keys).schema)
    return ready.mapInArrow(run, f"{key_types}, {ALIGNMENT}")
