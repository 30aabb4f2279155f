import itertools
import random

from strandweave.operators import select
from strandweave.operators.select import Node
from strandweave.params import AlignParams

P = AlignParams()


def node(k, sqo, n, seq_id=0, sro=None, strand="+"):
    sro = sqo + 1000 if sro is None else sro
    return Node(k, sqo, sqo + n - 1, sro, sro + n - 1, seq_id, strand, n, [("M", n)])


def brute(nodes, p):
    """Best total over all paths of nodes that don't overlap on the read."""
    best = 0
    for n in range(1, len(nodes) + 1):
        for path in itertools.combinations(nodes, n):
            total = path[0].score
            for a, b in zip(path, path[1:]):
                if b.sqo - a.sqo < p.min_non_overlap or b.eqo - a.eqo < p.min_non_overlap or b.sqo <= a.eqo:
                    break
                total += b.score - select.join_cost(a, b, p)
            else:
                best = max(best, total)
    return best


def test_coverage_is_the_best_path_without_overlaps():
    r = random.Random(1)
    for _ in range(200):
        nodes, at = [], 0
        starts = sorted(r.sample(range(0, 600, 30), 7))
        for k, s in enumerate(starts):
            room = (starts[k + 1] if k + 1 < len(starts) else 640) - s
            nodes.append(node(k, s, min(room, 30 + r.randint(0, 20)), r.randint(0, 2), r.randint(0, 10**6)))
        nodes.sort(key=lambda n: (n.sqo, -n.eqo))
        path = select.coverage_path(nodes, P)
        total = nodes[path[0]].score + sum(nodes[b].score - select.join_cost(nodes[a], nodes[b], P) for a, b in zip(path, path[1:]))
        assert total == brute(nodes, P)
        assert all(nodes[b].sqo - nodes[a].sqo >= P.min_non_overlap and nodes[b].eqo - nodes[a].eqo >= P.min_non_overlap for a, b in zip(path, path[1:]))


def test_overlap_is_paid_once():
    a, b = node(0, 0, 100), node(1, 60, 100, seq_id=1)
    assert select.coverage_path([a, b], P) == [0, 1]
    assert b.best == 100 + 100 - 25 - 40
    a, b = node(0, 0, 100), node(1, 25, 101, seq_id=1)
    assert select.coverage_path([a, b], P) == [1]


def test_prune():
    big, inside, repeat, other = node(0, 0, 400), node(1, 50, 40, 1), node(2, 0, 400), node(3, 300, 200, 2)
    other.score = 30
    kept = select.prune(sorted([big, inside, repeat, other], key=lambda n: (n.sqo, -n.eqo, -n.score, n.key)))
    assert [n.key for n in kept] == [0, 3]


def test_choose_numbers_primaries_and_leaves_alternatives():
    nodes = [node(0, 0, 100), node(1, 0, 100, 1), node(2, 100, 100, 2), node(3, 5, 60, 3)]
    first, rest = select.choose(nodes, P)
    assert len(first) == 2 and first[1] == 2 and first[0] in (0, 1) and set(first) | set(rest) == {0, 1, 2, 3}


def test_deletions_count_whole_and_last_op_is_cut():
    ops = [("M", 3), ("D", 2), ("M", 4)]
    assert [select.score_of_first(ops, n, P) for n in (0, 2, 3, 4, 99)] == [0, 2, 3, 3 - 9 + 1, 7 - 9]
