"""Exact substring deduplication by bucket-pointer refinement.

A suffix array that is sorted to a depth of `window` bytes groups equal
windows. Bucket-pointer refinement gets there from q-gram buckets: a bucket
is refined by the bucket identifiers at a later offset, and refined
identifiers serve the next refinement. Over a corpus the same idea runs in
levels, so that only contested positions travel:

1. Every window names its bucket by the least of its 20-byte grams, and
   neighbouring windows of one bucket form a run. A run goes to its bucket
   once per task, as (bucket, identifier of the run's bytes, document): runs
   that a smaller document has whole are settled.
2. Buckets with several different runs are refined: the bytes of their runs
   alone meet in the bucket's task, where bucket-pointer refinement sorts
   their windows. A run comes back with a bit per removed window.
3. Every document then removes what was settled.

The order of grams puts common ones last. What is common is learnt from a
bounded sample of documents into a table of fixed size: any order gives the
same result, this one only keeps a passage that a third of all documents
share from making one bucket of all their surroundings.

Identifiers of runs are 48-bit hashes within a bucket; equal bytes always
have equal ones.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import materialize, prepare

WINDOW = 50
GRAM = 20
PIECE = 32
CHUNK_BYTES = 3_000_000
CHUNK_DOCS = 50_000
BUCKET_BYTES = 32_000_000
SLICE_BYTES = 1_000_000
SAMPLE_DOCS, SAMPLE_BYTES = 6_000, 24_000_000
TABLE_BITS = 24
BLOCK = 1 << 16

_rng = np.random.default_rng(20)
_LETTERS = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, np.uint64)
_ODD = _rng.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[11]) | 5
_POWERS = np.cumprod(np.full(BLOCK + GRAM, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(BLOCK + GRAM, pow(_BASE, -1, 1 << 64), np.uint64))
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _ODD[0]
    x ^= x >> np.uint64(29)
    return x


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return _mix(a * _ODD[k] + b)


def grams(data: np.ndarray) -> np.ndarray:
    """63-bit identifiers of all GRAM-byte grams, from differences of prefix sums over blocks."""
    out = np.empty(max(0, len(data) - GRAM + 1), np.uint64)
    for at in range(0, len(out), BLOCK):
        part = data[at : at + BLOCK + GRAM - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTERS[part] * _POWERS[: len(part)], out=sums[1:])
        n = len(part) - GRAM + 1
        out[at : at + n] = _mix((sums[GRAM:] - sums[:n]) * _INVERSES[:n]) >> np.uint64(1)
    return out


class Runs:
    """Runs of windows of several texts laid end to end: first and last window, document, bucket and identifier of each."""

    def __init__(self, texts: list[bytes], common: np.ndarray | None = None):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(lens)
        self.starts = self.stops - lens
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        m = max(0, n - WINDOW + 1)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.bucket = self.run = np.zeros(0, np.uint64)
        if not m:
            return
        gram = grams(self.data)
        low = np.empty(m, np.uint64)
        span = WINDOW - GRAM
        for at in range(0, m, BLOCK):
            part = gram[at : min(at + BLOCK, m) + span]
            if common is not None:
                part = part | common[part >> np.uint64(63 - TABLE_BITS)].astype(np.uint64) << np.uint64(63)
            for step in (1, 2, 4, 8, 15):
                part = np.minimum(part[:-step], part[step:])
            low[at : at + BLOCK] = part
        tails = np.minimum(WINDOW - 1, lens)
        ends = np.cumsum(tails)
        invalid = np.repeat(self.stops - ends, tails) + np.arange(ends[-1])
        valid = np.ones(n, bool)
        valid[invalid] = False
        valid = valid[:m]
        starts = valid.copy()
        starts[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        ends = valid.copy()
        ends[:-1] &= starts[1:] | ~valid[1:]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        pieces = (last - first) // PIECE + 1
        if len(pieces) and pieces.max() > 1:
            bounds = np.cumsum(pieces)
            first = np.repeat(first - (bounds - pieces) * PIECE, pieces) + np.arange(bounds[-1]) * PIECE
            last = np.minimum(first + PIECE - 1, np.repeat(last, pieces))
        self.first, self.last = first, last
        self.doc = np.searchsorted(self.stops, first, "right")
        self.bucket = low[first]
        ids = [_join(_join(gram[x], gram[x + GRAM], 6), gram[x + span], 7) for x in (first, last)]
        self.run = _join(_join(*ids, 8), (last - first).astype(np.uint64), 9) & _LOW48

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Start positions of all windows of the chosen runs."""
        return _ranges(self.first[chosen], self.last[chosen] - self.first[chosen] + 1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    stops = np.cumsum(sizes)
    return np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)


def bucket_pointer_refinement(text: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifier of each position of a byte array: its rank among all positions by the next `depth` bytes (fewer at the end; shorter sorts first).

    Buckets start as 2-gram buckets. Each round sorts only positions in
    buckets of two or more, by their own and the later offset's identifier.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.int64)
    key[:] = (text.astype(np.int64) + 1) * 257
    key[:-1] += text[1:].astype(np.int64) + 1
    size = np.bincount(key, minlength=257 * 257)
    bucket = (np.cumsum(size) - size)[key]  # a bucket is named by its first place
    crowded = size[key] > 1
    length = 2
    while length < depth:
        step = min(length, depth - length)
        open_ = np.flatnonzero(crowded)
        if not len(open_):
            break
        later = np.where(open_ + step < n, bucket[np.minimum(open_ + step, n - 1)], -1)
        own = bucket[open_]
        both = own << 31 | later + 1 if n < 1 << 31 else None
        order = np.argsort(both) if both is not None else np.lexsort((later, own))
        own, later, at = own[order], later[order], open_[order]
        head = np.r_[True, own[1:] != own[:-1]]
        new = head | np.r_[True, later[1:] != later[:-1]]
        place = np.arange(len(own))
        group = np.cumsum(new) - 1
        heads = place[head][np.cumsum(head) - 1]
        bucket[at] = (own + place - heads)[new][group]
        crowded[at] = np.bincount(group)[group] > 1
        length += step
    return bucket


def _chunks(batches, columns: int):
    """Lists of column values, gathered to CHUNK_BYTES of text (column 1) or CHUNK_DOCS rows, sorted by id (column 0)."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            text = (row[1] or "").encode()
            held.append((row[0], text, *row[2:]))
            size += len(text)
            if size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS:
                yield sorted(held, key=lambda r: r[0])
                held, size = [], 0
    if held:
        yield sorted(held, key=lambda r: r[0])


def _pairs(ids: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return _join(ids.copy(), docs.astype(np.uint64), 10)


def _learn_common(batches):
    """One row: the table of gram prefixes that two documents of the sample share, as packed bits."""
    table = np.zeros(1 << TABLE_BITS, bool)
    texts = [(t or "").encode() for b in batches for t in b.column(0).to_pylist()]
    seen = []
    for t in set(texts):  # an exact copy says nothing about surroundings
        seen.append(np.unique(grams(np.frombuffer(t, np.uint8))))
    if seen:
        every = np.sort(np.concatenate(seen))
        table[every[1:][every[1:] == every[:-1]] >> np.uint64(63 - TABLE_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()])], ["bits"])


_kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
_NAMES = ["part", "kind", "low", "high", "run", "ref", "docs", "text"]
_PACKED = "part int, kind int, low binary, high binary, run binary, ref binary, docs binary, text binary"


def _packed(parts: int, bucket: np.ndarray, run: np.ndarray, doc: np.ndarray, ids: np.ndarray, size: np.ndarray | None = None, text: np.ndarray | None = None):
    """Rows of packed runs, one per part that has any: 5 bytes of bucket, 6 of run, 2 of the place in docs; with size and text, run bytes."""
    part = (bucket % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    starts = None if size is None else np.cumsum(size) - size
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = by[cuts[p] : cuts[p + 1]]
        used, ref = np.unique(doc[own], return_inverse=True)
        mark = (bucket[own] // np.uint64(parts)) & np.uint64((1 << 40) - 1)
        low = mark.astype(np.uint32).tobytes() + (run[own] >> np.uint64(32)).astype(np.uint16).tobytes()
        high = (mark >> np.uint64(32)).astype(np.uint8).tobytes() + (b"" if size is None else size[own].astype(np.uint8).tobytes())
        yield p, 1, low, high, run[own].astype(np.uint32).tobytes(), ref.astype(np.uint16).tobytes(), ids[used].tobytes(), b"" if text is None else text[_ranges(starts[own], size[own])].tobytes()


def _unpacked(t: pa.Table, sizes: bool = False):
    """bucket, run and document of all packed rows (and run sizes and text)."""
    lows, highs, runs, refs, docs = (t.column(c).to_pylist() for c in ("low", "high", "run", "ref", "docs"))
    n = [len(r) // 2 for r in refs]
    mark = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(lows, n)]).astype(np.uint64)
    mark |= np.concatenate([np.frombuffer(x, np.uint8, k) for x, k in zip(highs, n)]).astype(np.uint64) << np.uint64(32)
    run = np.frombuffer(b"".join(runs), np.uint32).astype(np.uint64)
    run |= np.concatenate([np.frombuffer(x, np.uint16, k, 4 * k) for x, k in zip(lows, n)]).astype(np.uint64) << np.uint64(32)
    doc = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(r, np.uint16)] for d, r in zip(docs, refs)])
    if not sizes:
        return mark, run, doc
    size = np.concatenate([np.frombuffer(x, np.uint8, k, k) for x, k in zip(highs, n)]).astype(np.int64)
    return mark, run, doc, size, np.frombuffer(b"".join(t.column("text").to_pylist()), np.uint8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _kinds)], _NAMES)


def _emit_runs(parts: int, bits: bytes):
    def run(batches):
        common = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for rows in _chunks(batches, 2):
            ids = np.array([r[0] for r in rows], np.int64)
            r = Runs([x[1] for x in rows], common)
            if not len(r.run):
                continue
            order = np.argsort(r.run, kind="stable")  # rows are in order of ids already
            k, docs = r.run[order], ids[r.doc[order]]
            head = np.r_[True, k[1:] != k[:-1]]
            settled = docs > docs[head][np.cumsum(head) - 1]
            out = []
            if settled.any():
                key = np.unique(np.stack([docs[settled], k[settled].view(np.int64)]), axis=1)
                out.append((int(key[0, 0]) % parts, 0, b"", b"", key[1].tobytes(), b"", key[0].tobytes(), b""))
            pick = order[head]
            out += _packed(parts, r.bucket[pick], r.run[pick], r.doc[pick], ids)
            yield _batch(out)

    return run


def settle_runs(bucket: np.ndarray, run: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(docs, runs, 0) that a smaller document has whole, and (docs, runs, 1) whose bucket holds other runs of other documents."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    same = b[1:] == b[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(b) else order
    order = order[np.lexsort((doc[order], run[order], bucket[order]))]
    b, r, d = bucket[order], run[order], doc[order]
    if not len(b):
        return []
    head = np.r_[True, (b[1:] != b[:-1]) | (r[1:] != r[:-1])]
    least = d[head][np.cumsum(head) - 1]
    settled = d > least
    group = np.r_[True, b[1:] != b[:-1]]
    at = np.cumsum(group) - 1
    runs_in = np.bincount(at, head)
    low = np.minimum.reduceat(d, np.flatnonzero(group))
    high = np.maximum.reduceat(d, np.flatnonzero(group))
    contested = head & ((runs_in > 1) & (low < high))[at]
    return [(d[settled], r[settled], 0), (d[contested], r[contested], 1)]


def _settle(_, t):
    kind = t.column("kind").to_numpy()
    local, rest = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
    found = [(np.frombuffer(b"".join(local.column("docs").to_pylist()), np.int64), np.frombuffer(b"".join(local.column("run").to_pylist()), np.uint64), 0)]
    if rest.num_rows:
        found += settle_runs(*_unpacked(rest))
    return pa.table({
        "doc_id": np.concatenate([f[0] for f in found]),
        "run": np.concatenate([f[1].view(np.int64) for f in found]),
        "kind": np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found]),
    })


def _given(rows: list[tuple], column: int) -> np.ndarray:
    """Pair keys of the run identifiers that come with each row."""
    return _pairs(np.concatenate([np.array(x[column] or [], np.int64) for x in rows]).view(np.uint64), np.repeat(np.arange(len(rows)), [len(x[column] or []) for x in rows]))


def _emit_contested(parts: int, bits: bytes):
    def run(batches):
        common = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for rows in _chunks(batches, 3):
            ids = np.array([r[0] for r in rows], np.int64)
            r = Runs([x[1] for x in rows], common)
            key = _pairs(r.run, r.doc)
            chosen = np.flatnonzero(np.isin(key, _given(rows, 2)))
            chosen = chosen[np.unique(key[chosen], return_index=True)[1]]
            if len(chosen):
                size = r.last[chosen] - r.first[chosen] + WINDOW
                yield _batch(list(_packed(parts, r.bucket[chosen], r.run[chosen], r.doc[chosen], ids, size, r.data[_ranges(r.first[chosen], size)])))

    return run


def removed_windows(doc: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A bit per window of each run (the first is bit 0): does a smaller document have it? Runs lie end to end in text."""
    rank = bucket_pointer_refinement(text, WINDOW)
    inside = size - WINDOW + 1
    at = _ranges(np.cumsum(size) - size, inside)
    rank, owner = rank[at], np.repeat(np.arange(len(size)), inside)
    low = np.full(len(text) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, rank, doc[owner])
    gone = low[rank] < doc[owner]
    bit = _ranges(np.zeros(len(size), np.int64), inside)
    return np.bincount(owner[gone], np.exp2(bit[gone]), len(size)).astype(np.int64)


def _settle_windows(_, t):
    """Windows are shared within a bucket alone, so that buckets are taken in slices of bounded text."""
    bucket, run, doc, size, text = _unpacked(t, True)
    begin = np.cumsum(size) - size
    by = np.argsort(bucket, kind="stable")
    mask = np.zeros(len(run), np.int64)
    heads = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
    filled = np.r_[0, np.cumsum(size[by])]
    cuts = [0]
    for h in heads[1:].tolist():
        if filled[h] - filled[cuts[-1]] >= SLICE_BYTES:
            cuts.append(h)
    for a, b in zip(cuts, [*cuts[1:], len(by)]):
        own = by[a:b]
        mask[own] = removed_windows(doc[own], size[own], text[_ranges(begin[own], size[own])])
    some = mask > 0
    return pa.table({"doc_id": doc[some], "run": run[some].view(np.int64), "mask": mask[some]})


def _remove(keep_text: bool, bits: bytes):
    def run(batches):
        common = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for rows in _chunks(batches, 5):
            out: list[tuple] = []
            some = [x for x in rows if x[2] or x[3]]
            for doc, text, *_ in (x for x in rows if not (x[2] or x[3])):
                out.append((doc, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
            if some:
                r = Runs([x[1] for x in some], common)
                key = _pairs(r.run, r.doc)
                mask = np.where(np.isin(key, _given(some, 2)), np.int64((1 << PIECE) - 1), np.int64(0))
                given = _given(some, 3)
                if len(given):
                    masks = np.concatenate([np.array(x[4] or [], np.int64) for x in some])
                    order = np.argsort(given)
                    at = np.minimum(np.searchsorted(given[order], key), len(given) - 1)
                    mask |= np.where(given[order][at] == key, masks[order][at], 0)
                hit = np.flatnonzero(mask)
                sizes = r.last[hit] - r.first[hit] + 1
                bit = _ranges(np.zeros(len(hit), np.int64), sizes)
                at = (np.repeat(r.first[hit], sizes) + bit)[np.repeat(mask[hit], sizes) >> bit & 1 > 0]
                edge = np.zeros(len(r.data) + 1, np.int32)
                edge[at] += 1
                edge[at + WINDOW] -= 1
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                for (doc, text, *_), a, b in zip(some, r.starts, r.stops):
                    own = gone[a:b]
                    left = r.data[a:b][~own].tobytes()
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum())
                    out.append((doc, len(text), int(own.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*out), kinds, names)], names)

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes every byte covered by a WINDOW-byte string that also starts in a document with a smaller id.

    Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    keep_text, kept_text (a code point cut by a span becomes U+FFFD there, not
    in the digest). Null texts are empty, rows with a null id are dropped,
    rows of one id never remove from each other, and an empty table gives no
    rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, n = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    one_in = max(1, math.ceil(n / SAMPLE_DOCS), math.ceil(size / SAMPLE_BYTES))
    sample = src.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").repartition(1)
    learnt = sample.mapInArrow(_learn_common, "bits binary").first()
    bits = bytes(learnt[0]) if learnt else bytes(1 << (TABLE_BITS - 3))
    runs = src.mapInArrow(_emit_runs(parts, bits), _PACKED)
    settled = materialize(runs.groupBy("part").applyInArrow(_settle, "doc_id long, run long, kind int"), "runs")
    whole = settled.where("kind = 0").groupBy("doc_id").agg(F.collect_list("run").alias("whole"))
    contested = src.join(settled.where("kind = 1").groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "doc_id").select("doc_id", "text", "runs")
    packed = contested.mapInArrow(_emit_contested(parts, bits), _PACKED)
    masks = materialize(packed.groupBy("part").applyInArrow(_settle_windows, "doc_id long, run long, mask long"), "windows")
    partly = masks.groupBy("doc_id").agg(F.collect_list(F.struct("run", "mask")).alias("p")).select("doc_id", F.col("p.run").alias("partly"), F.col("p.mask").alias("masks"))
    told = whole.join(partly, "doc_id", "full")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return src.join(told, "doc_id", "left").select("doc_id", "text", "whole", "partly", "masks").mapInArrow(_remove(keep_text, bits), schema)
