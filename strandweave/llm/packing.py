"""Best-fit packing of tokenised documents with swap-based local search.

Only piece lengths matter for packing, and there are at most `capacity` of
them. The plan is therefore made on the histogram of lengths: groups of equal
bins (contents, multiplicity) are filled best-fit from the longest length
down, then underfull groups exchange items. The driver holds the histogram
and the groups, whose number depends on the capacity, not on the rows. Every
piece then finds its bin from its rank among the pieces of its length; the
ranks come from a two-level count, so that a hot length is split.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import materialize, prepare

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 500_000
MAX_TRIES = 5_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict[str, "WordCache"] = {}


class WordCache:
    """Token ids by blank-separated word; the tokenizer never joins across blanks, so a text's ids are its words' ids.

    A word is one or two parts: a final full stop or comma after letters is
    always a token run of its own. Parts of Latin-1 letters alone, nearly all
    of them in Western text, are lower-cased here and sent in bulk to the
    same merges without the tokenizer's text stages; an id that ends a part
    says so in its string. All other parts take the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        strings = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(strings.values()) + 1, bool)
        self.ends[[i for t, i in strings.items() if t.endswith("</w>")]] = True
        shifted = [*range(33), *range(127, 161), 173]
        self.to_bytes = {b: 256 + n for n, b in enumerate(shifted)}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.parts = np.zeros((1 << 16, 2), np.int32)  # of each word
        self.slots: dict[str, int] = {"": 0}
        self.ids, self.starts, self.lens, self.n = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def _store(self, new: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        at = len(self.slots)
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while at + len(new) > len(self.lens):
            self.lens, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.starts))
        self.ids[self.n : self.n + len(ids)] = ids
        self.lens[at : at + len(new)] = lens
        self.starts[at : at + len(new)] = self.n + np.cumsum(lens) - lens
        self.slots.update(zip(new, range(at, at + len(new))))
        self.n += len(ids)

    def _merge(self, new: list[str], ascii_only: bool) -> None:
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            line = " ".join(some) if ascii_only else " ".join(p.encode().decode("latin-1").translate(self.to_bytes) for p in some)
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            self._store(some, ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))

    def learn(self, new: list[str]) -> None:
        """Makes new words known."""
        one, two = [], []
        known = self.slots
        plain: dict[str, None] = {}
        latin: dict[str, None] = {}
        other: dict[str, None] = {".": None, ",": None}
        for w in new:
            end = ""
            core = w
            if w.isalpha() or w[-1] in ".," and (core := w[:-1]).isalpha():
                if core is not w:
                    end = w[-1]
                if core.isascii():
                    core = core.lower()
                    to = plain
                elif max(core) <= "\xff":
                    core = core.lower()
                    to = latin
                else:  # lower-casing may end it in a mark, which joins the full stop
                    core, end = w, ""
                    to = other
            else:
                core = w
                to = other
            if core not in known:
                to[core] = None
            one.append(core)
            two.append(end)
        self._merge(list(plain), True)
        self._merge(list(latin), False)
        rest = [p for p in other if p not in known]
        if rest:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            lens = np.fromiter(map(len, encoded), np.int64, len(rest))
            self._store(rest, np.fromiter((i for e in encoded for i in e), np.uint32, int(lens.sum())), lens)
        at = len(self.index)
        while at + len(new) > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        self.parts[at : at + len(new), 0] = np.fromiter(map(known.__getitem__, one), np.int64, len(new))
        self.parts[at : at + len(new), 1] = np.fromiter(map(known.__getitem__, two), np.int64, len(new))
        self.index.update(zip(new, range(at, at + len(new))))

    def encode(self, texts):
        """Yields the ids of each text of a list or Arrow array. Words are counted off by Arrow, so that Python sees each of a batch's words once."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.clear()
        known = np.fromiter(map(self.index.get, own, itertools.repeat(-1)), np.int32, len(own))
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            known[unknown] = np.arange(len(self.index), len(self.index) + len(unknown), dtype=np.int32)
            self.learn([own[i] for i in unknown.tolist()])
        parts = self.parts[known][coded.indices.to_numpy()].ravel()
        lens = self.lens[parts]
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        bounds = ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        for start in range(0, len(texts), 64):  # bounded arrays of ids
            stop = min(start + 64, len(texts))
            lo, hi = bounds[start], bounds[stop]
            a, b = np.searchsorted(ends, [lo, hi])
            some = lens[a:b]
            ids = self.ids[np.repeat(self.starts[parts[a:b]] - ends[a:b] + lo, some) + np.arange(hi - lo)]
            for i in range(start, stop):
                yield ids[bounds[i] - lo : bounds[i + 1] - lo]


def word_cache(path: str) -> WordCache:
    if path not in _tokenizers:
        _tokenizers[path] = WordCache(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids for every row; a null text is one piece of the end id alone. with_ids adds the ids themselves."""
    prepare(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        cache = word_cache(path)
        for b in batches:
            out: list[tuple] = []
            for doc, own in zip(b.column(0).to_pylist(), cache.encode(b.column(1))):
                ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc, p, at, len(part), zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
            cols = list(zip(*out)) or [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA + ", ids array<long>" * with_ids)


# A group is [multiplicity, free, {length: count per bin}].


def best_fit_groups(counts: dict[int, int], capacity: int) -> list[list]:
    """Best-fit decreasing over a histogram: equal bins stay together as one group."""
    by_free: dict[int, list[list]] = {}
    frees: list[int] = []

    def put(g: list) -> None:
        if g[1] not in by_free:
            by_free[g[1]] = []
            bisect.insort(frees, g[1])
        by_free[g[1]].append(g)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(frees, length)
            if i < len(frees):
                free = frees[i]
                mult, _, items = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free], frees[i]
            else:
                free, items = capacity, {}
                mult = -(-left // (capacity // length))
            k = free // length
            full = min(mult, left // k)
            if full:
                put([full, free - k * length, items | {length: items.get(length, 0) + k}])
                left -= full * k
            if mult > full and 0 < left < k:
                put([1, free - left * length, items | {length: items.get(length, 0) + left}])
                full, left = full + 1, 0
            if mult > full and items:
                put([mult - full, free, items])
    return [g for gs in by_free.values() for g in gs]


def _shift(a: list, b: list, capacity: int) -> tuple[dict, dict] | None:
    """The best change that moves weight from a, the emptier bin, into b: contents to give to b and to take back."""
    room = b[1]
    singles_a, singles_b = sorted(a[2]), sorted(b[2])
    best, found = 0, None

    def offer(gain: int, give: list[int], take: list[int]) -> None:
        nonlocal best, found
        if best < gain <= room:
            best, found = gain, (give, take)

    # lengths of a bin that differ add up to its capacity at most, so that it has fewer pairs of them than that
    pairs_a = sorted({(x + y, x, y) for x in singles_a for y in singles_a if x < y or x == y and a[2][x] > 1})
    pairs_b = sorted({(x + y, x, y) for x in singles_b for y in singles_b if x < y or x == y and b[2][x] > 1})
    for x in singles_a:
        offer(x, [x], [])
    for y in singles_b:
        i = bisect.bisect_right(singles_a, room + y) - 1
        if i >= 0:
            offer(singles_a[i] - y, [singles_a[i]], [y])
        i = bisect.bisect_right(pairs_a, (room + y, capacity, capacity)) - 1
        if i >= 0:
            offer(pairs_a[i][0] - y, list(pairs_a[i][1:]), [y])
    for s, x, y in pairs_b:
        i = bisect.bisect_right(singles_a, room + s) - 1
        if i >= 0:
            offer(singles_a[i] - s, [singles_a[i]], [x, y])
    return found


def local_search(groups: list[list], capacity: int, max_tries: int = MAX_TRIES) -> list[list]:
    """Moves, one-for-one and two-for-one exchanges from the emptiest bins into fuller ones.

    Each step raises the sum of squared fills, so it ends: at the lower bound
    on bins, when no exchange of any two bins raises it, or after max_tries
    tried pairs, which leaves a valid packing. Groups change as many bins at once as both
    have; the work depends on the number of groups, not of bins.
    """
    total = sum(g[0] * (capacity - g[1]) for g in groups)
    least = -(-total // capacity)
    bins: dict[tuple, list] = {}
    born: dict[tuple, int] = {}  # when a group came or grew
    done: dict[tuple, int] = {}  # up to when a group has been tried with all others as the emptier one
    clock = itertools.count()
    tries = 0

    def put(mult: int, items: dict[int, int]) -> None:
        """Equal bins are one group."""
        if mult and items:
            name = tuple(sorted(items.items()))
            bins.setdefault(name, [0, capacity - sum(x * k for x, k in items.items()), items])[0] += mult
            born[name] = next(clock)

    def step() -> tuple | None:
        nonlocal tries
        recent = sorted(born, key=born.get)
        ages = [born[n] for n in recent]
        for na in sorted(bins, key=lambda n: (-bins[n][1], n)):
            a = bins[na]
            for nb in recent[bisect.bisect_right(ages, done.get(na, -1)) :]:
                b = bins[nb]
                tries += 1
                if tries > max_tries:
                    return None
                if 0 < b[1] <= a[1] and (nb != na or a[0] > 1) and (found := _shift(a, b, capacity)):
                    return na, nb, found
            done[na] = ages[-1]
        return None

    for mult, _, items in groups:
        put(mult, dict(items))
    while sum(g[0] for g in bins.values()) > least and (found := step()):
        na, nb, (give, take) = found
        a, b = bins[na], bins[nb]
        m = min(a[0], b[0]) if na != nb else a[0] // 2
        ca, cb = dict(a[2]), dict(b[2])
        for giver, taker, items in ((ca, cb, give), (cb, ca, take)):
            for x in items:
                giver[x] -= 1
                taker[x] = taker.get(x, 0) + 1
        for n in (na, nb):
            bins[n][0] -= m
        for n in {na, nb}:
            if not bins[n][0]:
                del bins[n], born[n]
                done.pop(n, None)
        for c in (ca, cb):
            put(m, {x: k for x, k in c.items() if k})
    return list(bins.values())


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks by length: pieces `rank0 <= rank < rank0 + n` of a length go k to a bin, from bin `bin0`, at `offset`."""
    groups = local_search(best_fit_groups(counts, capacity), capacity)
    used = dict.fromkeys(counts, 0)
    rows, bin0 = [], 0
    for mult, _, items in groups:
        offset = 0
        for length in sorted(items, reverse=True):
            k = items[length]
            rows.append((length, used[length], bin0, offset, k))
            used[length] += mult * k
            offset += length * k
        bin0 += mult
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank0", "bin0", "offset", "k"), cols))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...), which should be materialised.

    Empty input gives empty output; ties among equal lengths go by a hash and
    then doc_id, piece, so the result doesn't depend on partitions. Repeated
    doc_ids are packed one by one.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan_runs(counts, capacity)
    split = {length: max(1, round(n**0.5)) for length, n in counts.items()}
    table = np.ones(capacity + 1, np.int64)
    for length, n in split.items():
        table[length] = n
    cell = F.expr("pmod(xxhash64(doc_id, piece), element_at(widths, cast(length as int) + 1))")
    placed = pieces.withColumn("widths", F.lit(table.tolist())).withColumn("cell", cell).drop("widths")
    sizes = placed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "cell"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("before", "cell")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(names).schema.fields) + ", sequence_id long, offset long"
    key = runs["length"] << 44
    starts = key + runs["rank0"]

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            inside = rank - runs["rank0"][at]
            seq = runs["bin0"][at] + inside // runs["k"][at]
            off = runs["offset"][at] + inside % runs["k"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises whole texts, cuts documents longer than the capacity, and packs the pieces.

    A null or empty text is the end id alone. Rows with a null or repeated
    doc_id are packed one by one; an empty table gives no rows; extra columns
    are ignored.
    """
    packed = pack(materialize(tokenize(docs, tokenizer_path, capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
