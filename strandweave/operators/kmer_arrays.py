"""K-mers as arrays: packing, counting and merging in numpy, over Arrow batches.

Whole tables of k-mers never cross a shuffle as rows. A task sorts some
millions of k-mers at a time and sends what it knows of each range of k-mers
as one block: sorted keys as differences, and values beside them, by byte
planes and compressed. A range is small enough for arrays with a place per
k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Ranges of k-mers, bases that are packed at once, k-mers that are sorted at once, keys in a block at most, rows in a batch that leaves.
RANGES, SLICE, SORTED, BLOCK, OUT = 4096, 1 << 21, 1 << 23, 1 << 14, 1 << 18
#: Bits of the fold that k-mers of reads are looked up in, as a power of 2; a k-mer has a bit by each factor.
FOLD = 26
MIXES = (2654435761, 2246822519)
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"TCAG")] = range(4)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column without nulls as bytes and row bounds."""
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = column.buffers()[2]
    data = np.frombuffer(text, np.uint8)[bounds[0] : bounds[-1]] if text is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "bases") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bases."""
    if not batch.num_rows:
        return
    ends = letters(batch.column(column))[1][1:]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def packed(data: np.ndarray, bounds: np.ndarray, word_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid): the number of the window at every place, and whether it is of ACGT alone and inside a row."""
    n = len(data) - word_len + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = _CODE[data]
    bad = code > 3
    valid = np.ones(len(data), bool)
    if bad.any():
        seen = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        valid[:n] = seen[word_len:] == seen[:n]
        code = code & 3
    for back in range(1, word_len):  # the last windows of a row would run into the next one
        late = bounds[1:] - back
        valid[late[late >= bounds[:-1]]] = False
    power, size = code.astype(np.uint32), 1
    keys, have = np.zeros(n, np.uint32), 0
    left = word_len
    while left:
        if left & 1:  # parts of growing size stand one before the other, from the window's end
            at = word_len - have - size
            keys |= power[at : at + n] << np.uint32(2 * have)
            have += size
        left >>= 1
        if left:
            power = power[:-size] << np.uint32(2 * size) | power[size:]
            size *= 2
    return keys, valid[:n]


def placed(batch: pa.RecordBatch, word_len: int, skip: int, piece: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, key) of every window; batch has chunk_id and bases, cut by piece."""
    data, bounds = letters(batch.column("bases"))
    keys, valid = packed(data, bounds, word_len)
    if among is not None:
        valid &= held(among, keys)
    at = np.flatnonzero(valid)
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(at, bounds)))
    pos = at - bounds[row] + batch.column("chunk_id").to_numpy().astype(np.int64)[row] * piece
    if skip > 1:
        on = pos % skip == 0
        at, row, pos = at[on], row[on], pos[on]
    return row, pos, keys[at]


def folded(keys: np.ndarray, mix: int) -> np.ndarray:
    return keys * np.uint32(mix) >> np.uint32(32 - FOLD)


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Are all of a key's bits set? Others than those that set them may have them set, too."""

    def on(keys, mix):
        h = folded(keys, mix)
        return bits[h >> np.uint32(3)] >> (h & np.uint32(7)).astype(np.uint8) & 1 == 1

    found = on(keys, MIXES[0])
    for mix in MIXES[1:]:
        at = np.flatnonzero(found)
        found[at] = on(keys[at], mix)
    return found


def at_most(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the first n of each key stand."""
    order = np.argsort(keys, kind="stable")
    first, many = runs(keys[order])
    return np.sort(order[np.arange(len(keys)) - np.repeat(first, many) < n])


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers by bytes of equal weight, compressed."""
    kind = np.ascontiguousarray(values)
    return pa.compress(np.ascontiguousarray(kind.view(np.uint8).reshape(len(kind), kind.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unplaned(block: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    told = np.frombuffer(pa.decompress(block, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(told.reshape(size, n).T).view(kind).ravel()


def range_bits(word_len: int) -> int:
    """Bits of a k-mer below its range."""
    return max(0, 2 * word_len - (RANGES.bit_length() - 1))


def blocks(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of runs of sorted keys, of at most BLOCK each."""
    ends = np.searchsorted(keys >> np.uint32(bits), np.arange(1, RANGES + 1))
    start = 0
    for r, end in enumerate(ends.tolist()):
        while start < end:
            stop = min(end, start + BLOCK)
            yield r, start, stop
            start = stop


def key_block(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint32(0)))


def block_keys(block: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplaned(block, n, np.uint32), dtype=np.uint32)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct one of sorted keys begins, and how often it stands there."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(keys))


def partial_counts(batches: Iterator[pa.RecordBatch], word_len: int, skip: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Blocks (range, size, keys, ns) of a task's k-mers: sorted some millions at a time."""
    waiting, size = [], 0

    def told():
        keys = np.sort(np.concatenate(waiting))
        first, n = runs(keys)
        keys = keys[first]
        rows = [(r, j - i, key_block(keys[i:j]), planes(n[i:j].astype(np.uint32))) for r, i, j in blocks(keys, range_bits(word_len))]
        for i in range(0, len(rows), 1024):
            part = list(zip(*rows[i : i + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.binary())], ["range", "size", "keys", "ns"])

    for whole in batches:
        for b in slices(whole):
            if skip > 1:
                keys = placed(b, word_len, skip, piece)[2]
            else:
                keys, valid = packed(*letters(b.column("bases")), word_len)
                keys = keys[valid]
            waiting.append(keys)
            size += len(keys)
            if size >= SORTED:
                yield from told()
                waiting, size = [], 0
    if size:
        yield from told()


def merged_counts(batches: Iterator[pa.RecordBatch], word_len: int) -> Iterator[pa.RecordBatch]:
    """(kmer, n, range, inside) of blocks that come by range; inside counts the range's positions of smaller k-mers."""
    bits = range_bits(word_len)
    at, total = None, np.zeros(1 << bits, np.int64)

    def told():
        found = np.flatnonzero(total)
        n = total[found]
        inside = np.cumsum(n) - n
        for i in range(0, len(found), OUT):
            k = found[i : i + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(k + (at << bits)), pa.array(n[i : i + OUT]), pa.array(np.full(len(k), at, np.int32)), pa.array(inside[i : i + OUT])], ["kmer", "n", "range", "inside"])

    for b in batches:
        for r, size, keys, ns in zip(*(b.column(c).to_pylist() for c in ("range", "size", "keys", "ns"))):
            if r != at:
                if at is not None:
                    yield from told()
                    total[:] = 0
                at = r
            total[block_keys(keys, size).astype(np.int64) - (at << bits)] += unplaned(ns, size, np.uint32)
    if at is not None:
        yield from told()


def partial_places(batches: Iterator[pa.RecordBatch], word_len: int, span: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Blocks (range, size, keys, ns, lows, reaches, base) of a task's k-mers: number, least and greatest place seq_id * span + pos."""
    waiting, size = [], 0

    def told():
        keys, places = (np.concatenate(c) for c in zip(*waiting))
        base = int(places.min())
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order] - base
        first, n = runs(keys)
        low, high = np.minimum.reduceat(places, first), np.maximum.reduceat(places, first)
        keys = keys[first]
        # seq_id and pos apart: high bytes of both are mostly equal
        parts = [low // span, low % span, high - low]
        rows = [(r, j - i, key_block(keys[i:j]), planes(n[i:j].astype(np.uint32)), *(planes(p[i:j]) for p in parts), base) for r, i, j in blocks(keys, range_bits(word_len))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64()]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256]), kinds)], ["range", "size", "keys", "ns", "ids", "at", "reach", "base"])

    for whole in batches:
        for b in slices(whole):
            row, pos, keys = placed(b, word_len, 1, piece)
            waiting.append((keys, b.column("seq_id").to_numpy().astype(np.int64)[row] * span + pos))
            size += len(keys)
            if size >= SORTED:
                yield from told()
                waiting, size = [], 0
    if size:
        yield from told()


def merged_places(batches: Iterator[pa.RecordBatch], word_len: int, span: int, over: int) -> Iterator[pa.RecordBatch]:
    """(kmer, n, first, last) of k-mers with more than `over` positions, of blocks that come by range."""
    bits = range_bits(word_len)
    at, total = None, np.zeros(1 << bits, np.int64)
    ends = np.iinfo(np.int64)
    low, high = np.full(1 << bits, ends.max), np.full(1 << bits, ends.min)

    def told():
        found = np.flatnonzero(total > over)
        for i in range(0, len(found), OUT):
            k = found[i : i + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(k + (at << bits)), pa.array(total[k]), pa.array(low[k]), pa.array(high[k])], ["kmer", "n", "first", "last"])

    for b in batches:
        for r, size, keys, ns, ids, pos, reach, base in zip(*(b.column(c).to_pylist() for c in ("range", "size", "keys", "ns", "ids", "at", "reach", "base"))):
            if r != at:
                if at is not None:
                    yield from told()
                    total[:], low[:], high[:] = 0, ends.max, ends.min
                at = r
            k = block_keys(keys, size).astype(np.int64) - (at << bits)
            total[k] += unplaned(ns, size, np.uint32)
            begin = unplaned(ids, size, np.int64) * span + unplaned(pos, size, np.int64) + base
            low[k] = np.minimum(low[k], begin)
            high[k] = np.maximum(high[k], begin + unplaned(reach, size, np.int64))
    if at is not None:
        yield from told()


def bucket_requests(bucket: int, cut: pa.Table, word_len: int, skip: int, piece: int) -> pa.Table:
    """A bucket's distinct k-mers and their numbers, by range."""
    keys = np.sort(bucket_keys(cut, word_len, skip, piece)[2])
    first, n = runs(keys)
    keys = keys[first]
    rows = [(bucket, r, j - i, i, key_block(keys[i:j]), planes(n[i:j].astype(np.uint32))) for r, i, j in blocks(keys, range_bits(word_len))]
    kinds = [*[pa.int32()] * 4, pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["bucket", "range", "size", "at", "keys", "ns"])


def bucket_keys(cut: pa.Table, word_len: int, skip: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, key) of all windows of a bucket."""
    parts, start = [], 0
    for b in cut.combine_chunks().to_batches():
        for s in slices(b):
            row, pos, key = placed(s, word_len, skip, piece)
            parts.append((row + start, pos, key))
            start += s.num_rows
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def answered(requests: pa.Table, word_len: int) -> pa.Table:
    """A range's requests (bucket, at, size) with the number of every k-mer over all buckets."""
    bits = range_bits(word_len)
    at = requests.column("range")[0].as_py() << bits
    total = np.zeros(1 << bits, np.int64)
    rows = requests.select(["bucket", "at", "size", "keys", "ns"]).to_pylist()
    for r in rows:
        total[block_keys(r["keys"], r["size"]).astype(np.int64) - at] += unplaned(r["ns"], r["size"], np.uint32)
    told = [planes(total[block_keys(r["keys"], r["size"]).astype(np.int64) - at]) for r in rows]
    return pa.Table.from_arrays([requests.column("bucket").combine_chunks(), requests.column("at").combine_chunks(), requests.column("size").combine_chunks(), pa.array(told, pa.binary())], ["bucket", "at", "size", "totals"])


def bucket_counts(cut: pa.Table, answers: pa.Table, word_len: int, skip: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, key, n) of all windows of a bucket, from the answers to its requests."""
    row, pos, key = bucket_keys(cut, word_len, skip, piece)
    rows = sorted(answers.to_pylist(), key=lambda r: r["at"])
    totals = np.concatenate([unplaned(r["totals"], r["size"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    _, n = runs(key[order])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(totals, n)
    return row, pos, key, out
