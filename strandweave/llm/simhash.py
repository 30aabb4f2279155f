"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits have a common variant
within `radius // 2` bits of either. Every distinct fingerprint therefore
meets its partners on shared variants. Variants are not shipped one by one:
a fingerprint goes once to every variant *prefix* within reach, and the task
of a prefix expands the variants below it. Fingerprints that share a variant
lie within the radius of each other (triangle inequality), so a collision is
a verified link, and a star per variant keeps every link's reachability
without listing pairs inside a group.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import connected_components, discard, materialize, prepare, smallest_labels

BITS = 64
BLOCK_VARIANTS = 4_000_000
FINGERPRINTS_PER_PREFIX = 1_000
BANDS, ROWS = 16, 4
PIVOT_ROUNDS = 2
SKETCH_BITS, SLACK = 1024, 4.5

_rng = np.random.default_rng(64)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
_SKETCH_ODD = _rng.integers(0, 2**63, SKETCH_BITS, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_FLIPS = _rng.integers(0, 2**63, SKETCH_BITS, np.uint64)


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle of a UTF-8 text, repeats included; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(line, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(lens)
    starts = (stops - lens)[: len(words) - k + 1].tolist()
    ends = (stops[k - 1 :] - 1).tolist()
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit per position that over half the hashes have set; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<u8")[0])


def fingerprint_bytes(text: bytes, k: int, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text, as an unsigned integer; 0 without words."""
    return fingerprint(shingle_hashes(text, k, seed))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minimum hashes each: texts with similar shingle sets share some. None without hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, ((hashes[at : at + 4096, None] ^ _FLIPS) * _ODD >> np.uint64(20)).min(axis=0), out=low)
    mixed = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ mixed[:, r]) * _ODD[r]
        key ^= key >> np.uint64(32)
    return key.view(np.int64)[: BANDS if len(hashes) else 0]


def sketch_bits(hashes: np.ndarray) -> np.ndarray:
    """A bit of each of SKETCH_BITS minimum hashes, as longs."""
    low = np.full(SKETCH_BITS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[at : at + 512, None] ^ _SKETCH_FLIPS) * _SKETCH_ODD >> np.uint64(20)).min(axis=0), out=low)
    return np.packbits((low & np.uint64(1)).astype(bool)).view(np.int64)


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): SimHash of every whole text over k-word shingles, repeats included. Null texts have no words."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint_bytes((t or "").encode(), k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _collisions(values: np.ndarray, owner: np.ndarray, left: np.ndarray, bit: int, out: list) -> None:
    """Links owners that share a variant. values have been flipped above `bit`; left is how many flips each may still make below."""
    if len(values) < 2:
        return
    n = bit
    sizes = np.array([1, 1 + n, 1 + n + n * (n - 1) // 2])
    if bit > 8 and sizes[left].sum() > BLOCK_VARIANTS:
        low = np.uint64(1) << np.uint64(bit - 1)
        is_one = (values & low) != 0
        for want in (False, True):
            stay = is_one == want
            move = ~stay & (left > 0)
            _collisions(np.concatenate([values[stay], values[move] ^ low]), np.concatenate([owner[stay], owner[move]]), np.concatenate([left[stay], left[move] - 1]), bit - 1, out)
        return
    ones = [np.uint64(1) << np.uint64(i) for i in range(n)]
    flips = [np.array([0], np.uint64), np.array([0, *ones], np.uint64), np.array([0, *ones, *(x | y for x, y in combinations(ones, 2))], np.uint64)]
    keys, ids = [], []
    for r in range(3):
        of = left == r
        if of.any():
            keys.append((values[of][:, None] ^ flips[r][None, :]).ravel())
            ids.append(np.repeat(owner[of], len(flips[r])))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    same = keys[1:] == keys[:-1]
    if same.any():
        # links to the neighbour in the sorted run connect the run as a star would
        pairs = np.stack([np.minimum(ids[1:][same], ids[:-1][same]), np.maximum(ids[1:][same], ids[:-1][same])], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        out.append(np.unique(pairs, axis=0))


def ball_links(fps: np.ndarray, prefix: int, prefix_bits: int, half: int) -> np.ndarray:
    """(fp, root) pairs that connect the distinct fingerprints sharing a variant below this prefix."""
    fps = np.unique(fps)
    shift = np.uint64(BITS - prefix_bits)
    away = (fps >> shift) ^ np.uint64(prefix)
    left = half - np.bitwise_count(away).astype(np.int64)
    reach = left >= 0
    fps, away, left = fps[reach], away[reach], left[reach]
    out: list = []
    _collisions(fps ^ (away << shift), np.arange(len(fps)), left, BITS - prefix_bits, out)
    if not out:
        return np.empty((0, 2), np.uint64)
    pairs = np.concatenate(out)
    if (np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) > 2 * half).any():
        raise AssertionError("fingerprints that share a variant lie within the radius")
    label = smallest_labels(len(fps), pairs[:, 0], pairs[:, 1])
    moved = label != np.arange(len(fps))
    return np.stack([fps[moved], fps[label[moved]]], 1)


def link_fingerprints(distinct_fps: DataFrame, radius: int = 4) -> DataFrame:
    """(node long, root long) over the fingerprints (column fp) that link to another at `radius` or fewer differing bits."""
    half = radius // 2
    if radius % 2 or half > 2:
        raise ValueError("radius must be 0, 2 or 4")
    n = distinct_fps.count()
    bits = min(24, max(4, math.ceil(math.log2(max(2, n) / FINGERPRINTS_PER_PREFIX))))
    masks = [sum(1 << i for i in c) for r in range(half + 1) for c in combinations(range(bits), r)]
    routed = distinct_fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("fp", F.expr(f"shiftrightunsigned(fp, {BITS - bits}) ^ mask").alias("prefix"))

    def run(key, t):
        links = ball_links(t.column("fp").to_numpy().view(np.uint64), int(key[0].as_py()), bits, half)
        return pa.table({"a": links[:, 0].view(np.int64), "b": links[:, 1].view(np.int64)})

    return connected_components(routed.groupBy("prefix").applyInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): the smallest id reachable over links of `radius` or fewer bits.

    Null and blank texts have fingerprint 0 and link like any other; repeated
    rows of one id stay; rows with a null id get the component of their text
    but never name one; an empty table gives no rows; extra columns are ignored.
    Copies collapse to one fingerprint before any linking, and their ids to a minimum.
    """
    fps = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    return _components(fps, radius).select(F.col("id").alias("doc_id"), "fp", "component_id")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """Adds component_id to (id, fp, ...)."""
    distinct = fps.groupBy("fp").agg(F.min("id").alias("low"))
    labels = link_fingerprints(distinct.select("fp"), radius)
    rooted = materialize(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")  # else its side of the join could not be split for a hot root
    member = materialize(rooted.join(lows, "root").select("fp", "component_id"), "members")
    return fps.join(member, "fp")


def near_copies(docs: DataFrame, k: int = 5, radius: int = 4, min_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): as near_duplicates, with links between texts whose shingle sets have a Jaccard similarity of min_percent or more as well.

    At four bits of 64, fingerprints alone find nearly all pairs from 0.9 on,
    but few at 0.8. Each document therefore also has 16 keys of four minimum
    hashes, which share one with probability 0.9998 at 0.8. Members of a key
    that nothing links yet are compared by their whole shingle sets: first
    with the member that meets most others, which an original does among its
    copies, then those outside a key's largest component with all others that
    a sketch of one-bit minimum hashes doesn't rule out.
    Null and blank texts link to each other by their fingerprint alone; rows
    with a null id are dropped; repeated rows stay; an empty table gives no
    rows; extra columns are ignored.
    """
    return copy_groups(docs, k, radius, min_percent, id_col, text_col).select(F.col("id").alias("doc_id"), "component_id")


def copy_groups(docs: DataFrame, k: int = 5, radius: int = 4, min_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name long, component_id, group long): a row per row of docs with an id, by near_copies. name is the xxhash64 of the text; rows of one id are judged by their own texts, so that several groups may have the same smallest id.

    Joins with a side that grows are hinted to shuffle, so that the plan is the same at every size. Whole texts move once, to fetch those that share a key.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("name"), text.alias("text")).where("id is not null")

    def sketch(batches):
        for b in batches:
            fps, sets, sizes, keys = [], [], [], []
            for t in b.column(2).to_pylist():
                every = shingle_hashes((t or "").encode(), k)
                own = np.unique(every)
                fps.append(fingerprint(every))
                sets.append(_set_name(own))
                sizes.append(len(own))
                keys.append(band_keys(own))
            columns = [b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sets, np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "name", "fp", "set", "n", "keys"])

    known = materialize(src.mapInArrow(sketch, "id long, name long, fp long, set long, n long, keys array<long>"), "sketches")
    labels = link_fingerprints(known.select("fp").distinct(), radius).withColumnRenamed("node", "fp")
    # graph nodes are fingerprints, not ids, which rows with different texts may share
    rows = materialize(known.select("id", "name", "fp", "set", "n").join(labels.hint("merge"), "fp", "left").select("id", "name", "set", "n", F.coalesce("root", "fp").alias("node")), "linked")
    # one text speaks for all with its set of shingles, and its node is linked to all of theirs
    lead = materialize(rows.groupBy("set").agg(F.min(F.struct("node", "id", "name", "n")).alias("lead"), F.max("node").alias("_top")).select("set", "lead.*", "_top"), "leads")
    several = lead.where("node <> _top").select("set", F.col("node").alias("b"))
    links = materialize(rows.join(several.hint("merge"), "set").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "links")
    # keys of one set are the same wherever it is: a key counts once per set
    key = materialize(known.select("set", F.explode("keys").alias("key")).distinct(), "keys")
    discard(known)
    shared = key.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = materialize(key.join(shared.hint("merge"), "key"), "shared")
    discard(key)
    score = met.groupBy("set").agg(F.sum("members").alias("score")).join(lead.hint("merge"), "set").select("set", "score", "n", "node", "id", "name")
    score = materialize(score, "scores")
    live = materialize(met.select("set", "key").join(score.select("set", "score", "n", "node").hint("merge"), "set"), "live")
    discard(met)
    live = _open(live, connected_components(links))

    def sets_of(batches):
        for b in batches:
            own = [np.unique(shingle_hashes((t or "").encode(), k)) for t in b.column(0).to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([_set_name(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], kind), pa.array([sketch_bits(x) for x in own], kind)], ["set", "s", "bits"])

    wanted = score.join(live.select("set").distinct().hint("merge"), "set", "left_semi").select("id", "name")
    # a repeated row may repeat a link, no more
    sets = materialize(src.join(wanted.hint("merge"), ["id", "name"], "left_semi").select("text").mapInArrow(sets_of, "set long, s array<long>, bits array<long>"), "sets")

    def add(pairs: DataFrame) -> DataFrame:
        """links and those of the pairs (set, node, to_set, to_node) that are alike."""
        both = pairs.join(sets.select("set", "s").hint("merge"), "set").join(sets.select(F.col("set").alias("to_set"), F.col("s").alias("to_s")).hint("merge"), "to_set")
        close = both.withColumn("_i", F.size(F.array_intersect("s", "to_s"))).where(F.col("_i") * 100 >= (F.size("s") + F.size("to_s") - F.col("_i")) * min_percent)
        return links.unionByName(materialize(close.select(F.col("node").alias("a"), F.col("to_node").alias("b")).distinct(), "found"))

    alike = F.least("n", "to.n") * 100 >= F.greatest("n", "to.n") * min_percent
    for _ in range(PIVOT_ROUNDS):
        if live.isEmpty():
            break
        pivots = live.groupBy("key").agg(F.max(F.struct("score", "set", "n", "node", "at")).alias("to"))
        pairs = live.join(pivots.hint("merge"), "key").where(alike & (F.col("at") != F.col("to.at"))).select("set", "node", F.col("to.set").alias("to_set"), F.col("to.node").alias("to_node")).distinct()
        links = add(materialize(pairs, "candidates"))
        # pivots have met all other members of their keys
        rest = live.drop("at").join(pivots.select("key", "to.set").hint("merge"), ["key", "set"], "left_anti")
        last, live = live, _open(rest, connected_components(links))
        discard(last)
    if not live.isEmpty():
        pairs = materialize(left_pairs(live, sets, min_percent), "candidates")
        links = add(pairs)
    told = materialize(rows.join(connected_components(links).hint("merge"), "node", "left").select("id", "name", F.coalesce("root", "node").alias("root")), "merged")
    discard(rows, lead, score, live, sets)
    lows = materialize(told.groupBy("root").agg(F.min("id").alias("component_id")), "lows")  # else its side of the join could not be split for a hot root
    return told.join(lows.hint("merge"), "root").select("id", "name", "component_id", F.col("root").alias("group"))


def left_pairs(live: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """(set, node, to_set, to_node): the pairs of members (set, key, n, node, at) of a key in different components that may have a Jaccard similarity of min_percent or more.

    A key's largest component is not compared within itself. Of the others,
    pairs go whose sets differ too much in size or in SKETCH_BITS one-bit
    minimum hashes: these differ in (1 - J) / 2 of the bits, and the bound lies
    SLACK standard deviations above that, which loses 3 pairs in a million at
    the similarity itself. A pair is made once, at its first common key.
    """
    keys = live.groupBy("set").agg(F.collect_set("key").alias("keys"))  # at most BANDS
    most = live.groupBy("key", "at").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "at")).alias("most")).select("key", F.col("most.at").alias("main"))
    bits = sets.select("set", "bits").dropDuplicates(["set"])
    each = live.select("set", "key", "n", "node", "at").join(keys.hint("merge"), "set").join(bits.hint("merge"), "set").join(most.hint("merge"), "key")
    each = materialize(each, "left")
    to = each.select("key", F.struct("set", "n", "node", "at", "keys", "bits", "main").alias("to"))
    share = (1 - min_percent / 100) / 2
    limit = math.floor(SKETCH_BITS * share + SLACK * math.sqrt(SKETCH_BITS * share * (1 - share)))
    differ = " + ".join(f"bit_count(bits[{i}] ^ to.bits[{i}])" for i in range(SKETCH_BITS // 64))
    alike = f"at <> to.at and (to.at = main or `set` < to.`set`) and least(n, to.n) * 100 >= greatest(n, to.n) * {min_percent} and {differ} <= {limit} and key = array_min(array_intersect(keys, to.keys))"
    return each.where("at <> main").join(to.hint("merge"), "key").where(alike).select("set", "node", F.col("to.set").alias("to_set"), F.col("to.node").alias("to_node"))


def _open(members: DataFrame, merged: DataFrame) -> DataFrame:
    """The members (set, node, key, ...) of keys that hold more than one component, with the component as `at`; materialised."""
    now = materialize(members.join(merged.select("node", "root").hint("merge"), "node", "left").withColumn("at", F.coalesce("root", "node")).drop("root"), "now")
    some = now.groupBy("key").agg(F.min("at").alias("_low"), F.max("at").alias("_high")).where("_low <> _high").select("key")
    out = materialize(now.join(some.hint("merge"), "key", "left_semi"), "open")
    discard(now)
    return out


def _set_name(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63)
