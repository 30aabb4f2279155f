"""Which alignments of a read to report: duplicates, optimal coverage, near-equal alternatives, mapping quality."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.intervals import interval_overlap, mapping_quality, plus_end, plus_start
from strandweave.operators.align import PRIMARY
from strandweave.operators.dp import op_score
from strandweave.params import AlignParams
from strandweave.session import ship

PLACE = ("query_id", "strand", "seq_id", "sqo", "eqo", "sro", "ero")


def best_of_duplicates(alignments: DataFrame) -> DataFrame:
    """One alignment per place: the best-scoring one, by its edits among equals."""
    order = Window.partitionBy(*PLACE).orderBy(F.desc("score"), F.xxhash64("ops"))
    return alignments.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


@dataclass
class Node:
    """An alignment in the read's own direction."""

    key: int
    sqo: int
    eqo: int
    sro: int
    ero: int
    seq_id: int
    strand: str
    score: int
    ops: list
    best: int = 0
    before: int | None = None
    length: int = 1
    in_path: int = 0
    place: tuple = field(default=())

    @property
    def forward_ops(self) -> list:
        return self.ops[::-1] if self.strand == "-" else self.ops


def score_of_first(ops: list, n: int, p: AlignParams) -> int:
    """Score of the first n read bases; deletions met before the last of them count whole."""
    total = 0
    for op, size in ops:
        if n <= 0:
            break
        use = size if op == "D" else min(size, n)
        total += op_score(op, use, p)
        n -= 0 if op == "D" else use
    return total


def prune(nodes: list[Node]) -> list[Node]:
    """Without exact repeats and without nodes inside a far better one. nodes are sorted; a kept node looks ahead until one reaches further."""
    alive = [True] * len(nodes)
    for i, a in enumerate(nodes):
        if not alive[i]:
            continue
        for j in range(i + 1, len(nodes)):
            if not alive[j]:
                continue
            b = nodes[j]
            if b.eqo > a.eqo:
                break
            same = (a.sro, a.ero, a.strand, a.sqo, a.eqo, a.seq_id) == (b.sro, b.ero, b.strand, b.sqo, b.eqo, b.seq_id)
            if same or b.eqo < a.eqo and b.score < a.score // 8:
                alive[j] = False
    return [n for n, keep in zip(nodes, alive) if keep]


def join_cost(a: Node, b: Node, p: AlignParams) -> int:
    most = p.max_distance_log * p.breakpoint_penalty
    if a.seq_id != b.seq_id:
        return most
    apart = max(a.sro, b.sro) - min(a.ero, b.ero)
    if apart <= 10:
        return p.breakpoint_penalty
    return int(min(math.log10(apart), p.max_distance_log) * p.breakpoint_penalty + 0.5)


def _path(nodes: list[Node], at: int | None) -> list[int]:
    out = []
    while at is not None:
        out.append(at)
        at = nodes[at].before
    return out


def _tail_score(nodes: list[Node], path: list[int], n: int, p: AlignParams) -> int:
    """Score of the last n read bases of a path (its last node first), each node with what it holds of the path."""
    total = 0
    for k in path:
        if n <= 0:
            break
        use = min(n, nodes[k].in_path)
        total += score_of_first(nodes[k].forward_ops[::-1], use, p)
        n -= use
    return total


def _share_out(nodes: list[Node], end: int, p: AlignParams) -> None:
    """How many read bases each node of the path to `end` holds: an overlap goes to the side that scores more on it, the right one on a tie."""
    path = _path(nodes, end)[::-1]
    nodes[path[0]].in_path = nodes[path[0]].eqo - nodes[path[0]].sqo + 1
    for n, k in enumerate(path[1:], 1):
        left, right = nodes[path[n - 1]], nodes[k]
        right.in_path = right.eqo - right.sqo + 1
        over = max(0, left.eqo - right.sqo + 1)
        if not over:
            continue
        behind = path[:n][::-1]
        if _tail_score(nodes, behind, over, p) > score_of_first(right.forward_ops, over, p):
            right.in_path -= over
        else:
            for i in behind:
                cut = min(over, nodes[i].in_path)
                nodes[i].in_path -= cut
                over -= cut


def coverage_path(nodes: list[Node], p: AlignParams) -> list[int]:
    """Indices of the cheapest set of alignments that covers the read, left to right; nodes are sorted and pruned."""
    for n in nodes:
        n.best, n.before, n.length = n.score, None, 1
    end = 0
    for i, a in enumerate(nodes):
        _share_out(nodes, i, p)
        path = _path(nodes, i)
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if b.sqo - a.sqo < p.min_non_overlap or b.eqo - a.eqo < p.min_non_overlap:
                continue
            reached = a.best + b.score
            if b.best > reached:
                continue
            reached -= join_cost(a, b, p)
            if b.best > reached:
                continue
            over = max(0, a.eqo - b.sqo + 1)
            if over:
                reached -= min(score_of_first(b.forward_ops, over, p), _tail_score(nodes, path, over, p))
            if reached > b.best or reached == b.best and b.before is not None and nodes[b.before].length > a.length:
                b.best, b.before, b.length = reached, i, a.length + 1
        top = nodes[end]
        if a.best > top.best or a.best == top.best and a.length < top.length:
            end = i
    return _path(nodes, end)[::-1]


def _tie(n: Node) -> int:
    return xxhash.xxh64_intdigest(f"{n.seq_id}:{n.strand}:{n.sro}:{n.ero}:{n.sqo}:{n.eqo}:{n.ops}")


def choose(nodes: list[Node], p: AlignParams) -> tuple[list[int], list[int]]:
    """(keys of the primaries left to right, keys of the others that were not pruned)."""
    nodes = prune(sorted(nodes, key=lambda n: (n.sqo, -n.eqo, -n.score, _tie(n))))
    path = coverage_path(nodes, p)
    chosen = set(path)
    return [nodes[i].key for i in path], [n.key for i, n in enumerate(nodes) if i not in chosen]


def coverage(alignments: DataFrame, p: AlignParams) -> DataFrame:
    """Adds psqo, peqo (positions in the read's own direction), primary_ix (from 1; null: not primary) and n_primaries; pruned alignments go.

    A read's alignments meet in one row; the columns that the path search
    doesn't need pass through as Arrow arrays.
    """
    ship(alignments.sparkSession)
    plus = _with_plus(alignments)
    names = [c for c in plus.columns if c != "query_id"]
    grouped = plus.groupBy("query_id").agg(F.collect_list(F.struct(*names)).alias("a"))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            cols = dict(zip(names, flat.flatten()))
            values = list(zip(*(cols[c].to_pylist() for c in ("psqo", "peqo", "sro", "ero", "seq_id", "strand", "score", "ops"))))
            start, query, at, place, total = 0, [], [], [], []
            for i, n in enumerate(lists.value_lengths().to_pylist()):
                nodes = [Node(start + k, *v[:-1], [(o["op"], o["len"]) for o in v[-1]]) for k, v in enumerate(values[start : start + n])]
                first, rest = ([start], []) if n == 1 else choose(nodes, p)
                query += [i] * (len(first) + len(rest))
                at += first + rest
                place += [*range(1, len(first) + 1), *[None] * len(rest)]
                total += [len(first)] * (len(first) + len(rest))
                start += n
            took = pa.array(at, pa.int64())
            arrays = [b.column(0).take(pa.array(query, pa.int64())), *(cols[c].take(took) for c in names), pa.array(place, pa.int32()), pa.array(total, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", *names, "primary_ix", "n_primaries"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plus.select("query_id", *names).schema)
    return grouped.mapInArrow(run, f"{kinds}, primary_ix int, n_primaries int")


def _with_plus(alignments: DataFrame) -> DataFrame:
    place = (F.col("strand"), F.col("sqo"), F.col("eqo"), F.col("query_len"))
    return alignments.withColumns({"psqo": plus_start(*place), "peqo": plus_end(*place)})


def similar(covered: DataFrame, p: AlignParams) -> DataFrame:
    """Fills mapq, n_secondaries, matched_primary and status from coverage()'s result; others than primaries stay only as secondaries, and only with p.similar.

    Every other alignment belongs to the primary it overlaps most on the read,
    the leftmost of equals. It is a secondary if its score and both overlap
    shares reach the limits. All of a read's rows meet by one shuffle.
    """
    of_read, of_primary = Window.partitionBy("query_id"), Window.partitionBy("query_id", "matched_primary")
    lead = F.col("primary_ix").isNotNull()
    head = F.struct(F.col("primary_ix").alias("ix"), F.col("psqo").alias("s"), F.col("peqo").alias("e"), F.col("score").alias("score"))
    heads = F.collect_list(F.when(lead, head)).over(of_read)
    over = F.array_max(F.transform("_heads", lambda h: F.struct(interval_overlap(F.col("psqo"), F.col("peqo"), h["s"], h["e"]).alias("over"), (-h["ix"]).alias("ix"), h["s"].alias("s"), h["e"].alias("e"), h["score"].alias("score"))))
    tied = covered.withColumn("_heads", heads).withColumn("_h", F.when(~lead, over)).drop("_heads")
    o = F.col("_h.over")
    enough = (F.col("score") >= p.score_ratio * F.col("_h.score")) & (o >= p.reciprocal_length * (F.col("peqo") - F.col("psqo") + 1)) & (o >= p.reciprocal_length * (F.col("_h.e") - F.col("_h.s") + 1))
    tied = tied.withColumn("matched_primary", F.when(lead, F.col("primary_ix")).otherwise(-F.col("_h.ix"))).withColumn("_second", F.coalesce(enough, F.lit(False)))
    # the two best rivals of a primary, without a list of all of them on every row
    tied = tied.withColumn("_r", F.row_number().over(of_primary.orderBy(lead, F.desc("score"))))
    rival = lambda n: F.max(F.when(~lead & (F.col("_r") == n), F.col("score"))).over(of_primary)
    tied = tied.withColumns({"_s1": rival(1), "_s2": rival(2), "n_secondaries": F.when(lead, F.sum(F.col("_second").cast("int")).over(of_primary).cast("int"))})
    kept = tied.where(lead | F.col("_second")) if p.similar else tied.where(lead)
    told = kept.withColumns({
        "mapq": F.when(F.col("primary_ix").isNotNull(), mapping_quality(F.col("score"), F.col("_s1"), F.col("_s2"))).otherwise(F.col("mapq")),
        "status": F.when(F.col("primary_ix").isNotNull(), F.col("status").bitwiseOR(F.lit(PRIMARY))).otherwise(F.col("status")),
    })
    return told.select(*covered.columns, "n_secondaries", "matched_primary")


def select_alignments(alignments: DataFrame, p: AlignParams) -> DataFrame:
    """What is reported: optimal coverage (with alternatives, if wanted), or else every place once."""
    if p.optimal_coverage:
        return similar(coverage(alignments, p), p)
    none = F.lit(None).cast("int")
    return _with_plus(best_of_duplicates(alignments)).withColumns({c: none for c in ("primary_ix", "n_primaries", "n_secondaries", "matched_primary")})
