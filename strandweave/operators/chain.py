"""Chains of fragments: the best path through a region's fragments, again and again.

Positions are inclusive; a fragment is (sqo, sro, len).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.seeds import GROUP
from strandweave.params import AlignParams
from strandweave.session import ship

FRAGS = "array<struct<sqo: int, sro: bigint, len: int>>"
_ARROW = pa.list_(pa.struct([("sqo", pa.int32()), ("sro", pa.int64()), ("len", pa.int32())]))


@dataclass
class Frag:
    sqo: int
    sro: int
    len: int

    @property
    def eqo(self) -> int:
        return self.sqo + self.len - 1

    @property
    def ero(self) -> int:
        return self.sro + self.len - 1

    @property
    def diag(self) -> int:
        return self.sro - self.sqo

    def cut_front(self, n: int) -> None:
        self.sqo, self.sro, self.len = self.sqo + n, self.sro + n, self.len - n

    def copy(self) -> Frag:
        return Frag(self.sqo, self.sro, self.len)


def query_gap(a: Frag, b: Frag) -> int:
    return max(b.sqo - a.eqo - 1, 0)


def ref_gap(a: Frag, b: Frag) -> int:
    return max(b.sro - a.ero - 1, 0)


def shared(a: Frag, b: Frag) -> int:
    """The larger of both overlaps of a's end and b's start."""
    return max(a.eqo - b.sqo + 1, a.ero - b.sro + 1, 0)


def best_path(frags: list[Frag], p: AlignParams) -> list[int]:
    """Indices of the best chain, left to right; frags are sorted by (sqo, diag)."""
    n = len(frags)
    score = [f.len * p.match for f in frags]
    before: list[int | None] = [None] * n
    begins = [f.sqo for f in frags]
    end = 0
    for i, left in enumerate(frags):
        for j in range(n - 1, i, -1):
            right = frags[j]
            if right.sqo == left.sqo:
                break
            turn = abs(right.diag - left.diag)
            if turn > p.max_gap or left.sro >= right.sro or min(query_gap(left, right), ref_gap(left, right)) > p.max_desert:
                continue
            gained = right.len - shared(left, right)
            if gained < 1:
                continue
            reached = score[i] + gained * p.match + p.gap_cost(turn)
            if reached < score[j]:
                continue
            if reached == score[j]:
                rival = before[j]
                if rival is None:
                    continue
                held = frags[rival]
                mine = (turn, query_gap(left, right), -begins[i])
                theirs = (abs(right.diag - held.diag), query_gap(held, right), -begins[rival])
                if mine >= theirs:
                    continue
            score[j], before[j], begins[j] = reached, i, begins[i]
        if (-score[i], left.eqo, -begins[i]) < (-score[end], frags[end].eqo, -begins[end]):
            end = i
    path, at = [], end
    while at is not None:
        path.append(at)
        at = before[at]
    return path[::-1]


def trimmed(frags: list[Frag], path: list[int]) -> tuple[list[Frag], int]:
    """The chain's fragments without overlaps, and its matched bases. Cuts of a fragment's own end also change frags, and are seen by later rounds."""
    chain = [frags[path[-1]].copy()]
    matched = chain[0].len
    for i in reversed(path[:-1]):
        f, head = frags[i], chain[0]
        over = shared(f, head)
        if over:
            if f.len < head.len or f.len == head.len and len(chain) == 1:
                f.len -= over
            else:
                head.cut_front(over)
        matched += f.len
        chain.insert(0, f.copy())
    return chain, matched


def cleaned(chain: list[Frag], p: AlignParams) -> list[Frag]:
    """Without short fragments between anchors on nearly one diagonal, and without short ends that hang on a tight gap."""
    word = p.word_len
    out = [chain[0]]
    i = 1
    while i < len(chain):
        f = chain[i]
        if f.len >= word or i == len(chain) - 1:
            out.append(f)
            i += 1
            continue
        j = next((k for k in range(i, len(chain)) if chain[k].len >= word), len(chain) - 1)
        left, right = out[-1], chain[j]
        low, high = sorted((left.diag, right.diag))
        for k in range(i, j):
            d = chain[k].diag
            near = low <= d <= high or min(abs(d - left.diag), abs(d - right.diag)) <= p.band_width
            if not (high - low <= p.max_gap and near):
                out.append(chain[k])
        i = j if j > i else i + 1
        if i == j:
            out.append(chain[j])
            i = j + 1

    def hangs(a: Frag, b: Frag) -> bool:
        gaps = sorted((query_gap(a, b), ref_gap(a, b)))
        return gaps[0] == 0 and gaps[1] <= 2 * p.band_width

    if len(out) > 1 and out[0].len < word and hangs(out[0], out[1]):
        out = out[1:]
    if len(out) > 1 and out[-1].len < word and hangs(out[-2], out[-1]):
        out = out[:-1]
    return out


def chain_region(region: list[Frag], query_len: int, p: AlignParams) -> list[list[Frag]]:
    """All clumps of a region: take the best chain, cover its read span, drop fragments that the cover leaves too little of, repeat."""
    left = sorted(region, key=lambda f: (f.sqo, f.diag))
    covered = bytearray(query_len)
    found = []
    while left:
        path = best_path(left, p)
        chain, matched = trimmed(left, path)
        if matched < p.min_match:
            break
        clump = cleaned(chain, p)
        found.append(clump)
        a, b = clump[0].sqo, clump[-1].eqo
        covered[a : b + 1] = b"\x01" * (b - a + 1)
        gone, m = set(path), p.min_non_overlap
        left = [f for i, f in enumerate(left) if i not in gone and f.len >= m and (not any(covered[f.sqo : f.sqo + m]) or not any(covered[f.eqo - m + 1 : f.eqo + 1]))]
        left.sort(key=lambda f: (f.sqo, f.diag))
    return found


def chain_clumps(in_regions: DataFrame, p: AlignParams) -> DataFrame:
    """(*GROUP, region, clump, frags): the clumps of all regions; a region is gathered into one row. A region of one fragment is its own chain if long enough."""
    ship(in_regions.sparkSession)
    whole = in_regions.groupBy(*GROUP, "region").agg(F.max("eqo").alias("last"), F.array_sort(F.collect_list(F.struct("sqo", "sro", F.col("len").cast("int").alias("len")))).alias("frags"))
    whole = whole.where((F.size("frags") > 1) | (F.get("frags", 0)["len"] >= p.min_match))
    names = [*GROUP, "region"]

    def run(batches):
        for b in batches:
            rows, clump, frags = [], [], []
            for i, (last, some) in enumerate(zip(b.column("last").to_pylist(), b.column("frags").to_pylist())):
                found = chain_region([Frag(**f) for f in some], last + 1, p) if len(some) > 1 else [[Frag(**some[0])]]
                for k, chain in enumerate(found):
                    rows.append(i)
                    clump.append(k)
                    frags.append([{"sqo": f.sqo, "sro": f.sro, "len": f.len} for f in chain])
            taken = b.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(clump, pa.int32()), pa.array(frags, _ARROW)], [*names, "clump", "frags"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.select(names).schema)
    return whole.mapInArrow(run, f"{kinds}, clump int, frags {FRAGS}")
