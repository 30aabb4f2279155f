"""Dynamic programming, chains and splits against brute force."""

import itertools
import random

import pytest

from strandweave.operators import chain, dp
from strandweave.operators.align import Alignment, Site, align_clump, core_of, needs_split, settled
from strandweave.operators.chain import Frag
from strandweave.params import AlignParams

P = AlignParams()
WIDE = P.with_(max_gap=1000, max_intron=1000)


def replay(ops, q, r):
    """Does the edit list turn r into q, base by base?"""
    i = j = 0
    for k, (op, n) in enumerate(ops):
        assert n > 0 and (not k or ops[k - 1][0] != op)
        if op == "M":
            assert q[i : i + n] == r[j : j + n]
        if op == "R":
            assert all(a != b for a, b in zip(q[i : i + n], r[j : j + n]))
        i += n if op != "D" else 0
        j += n if op != "I" else 0
    return i, j


def gotoh(q, r, p):
    """Best global score, by three plain tables."""
    no = -(10**9)
    n, m = len(q), len(r)
    h = [[no] * (m + 1) for _ in range(n + 1)]
    e, f = [row[:] for row in h], [row[:] for row in h]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if j:
                e[i][j] = max(h[i][j - 1] - p.gap_open - p.gap_extend, e[i][j - 1] - p.gap_extend)
            if i:
                f[i][j] = max(h[i - 1][j] - p.gap_open - p.gap_extend, f[i - 1][j] - p.gap_extend)
            if i and j:
                h[i][j] = h[i - 1][j - 1] + (p.match if q[i - 1] == r[j - 1] else -p.replace)
            h[i][j] = max(h[i][j], e[i][j], f[i][j]) if i or j else 0
    return h


def some(r, n, chars=b"ACGT"):
    return bytes(r.choice(chars) for _ in range(n))


def mutated(r, s, rate):
    out = bytearray()
    for b in s:
        x = r.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out += some(r, 1)
        out += some(r, 1) if x > 1 - rate / 3 else bytes([b])
    return bytes(out)


def test_between_reaches_the_best_global_score():
    r = random.Random(1)
    for _ in range(300):
        a = some(r, r.randint(0, 14), b"AC")
        b = mutated(r, a, 0.5) if r.random() < 0.5 else some(r, r.randint(0, 10), b"AC")
        ops = dp.align_between(a, b, WIDE)
        assert replay(ops, a, b) == (len(a), len(b))
        wide = abs(len(a) - len(b)) + 2 * WIDE.band_width + 1 < len(b)
        if not wide and a and b:
            assert dp.edits_score(ops, WIDE) == gotoh(a, b, WIDE)[len(a)][len(b)], (a, b, ops)


def test_extension_reaches_the_best_prefix_score():
    r = random.Random(2)
    p = WIDE.with_(x_cutoff=10_000, band_width=50)
    for _ in range(300):
        a = some(r, r.randint(1, 20))
        b = mutated(r, a, 0.3) + some(r, 5)
        ops, score = dp.extend(a, b, p)
        i, j = replay(ops, a, b)
        assert score == dp.edits_score(ops, p)
        best = max(max(row) for row in gotoh(a, b, p)[1:])
        assert score == max(0, best), (a, b, ops)


def brute_chain(frags, p):
    best = None
    for n in range(1, len(frags) + 1):
        for path in itertools.combinations(range(len(frags)), n):
            s = frags[path[0]].len * p.match
            for a, b in zip(path, path[1:]):
                x, y = frags[a], frags[b]
                new = y.len - chain.shared(x, y)
                if not (x.sqo < y.sqo and x.sro < y.sro and abs(x.diag - y.diag) <= p.max_gap and min(chain.query_gap(x, y), chain.ref_gap(x, y)) <= p.max_desert and new >= 1):
                    break
                s += new * p.match + p.gap_cost(abs(x.diag - y.diag))
            else:
                best = s if best is None else max(best, s)
    return best


def path_score(frags, path, p):
    s = frags[path[0]].len * p.match
    for a, b in zip(path, path[1:]):
        s += (frags[b].len - chain.shared(frags[a], frags[b])) * p.match + p.gap_cost(abs(frags[a].diag - frags[b].diag))
    return s


def test_best_chain_is_the_best():
    r = random.Random(3)
    for _ in range(200):
        frags = sorted((Frag(r.randint(0, 120), 1000 + r.randint(0, 150), r.randint(15, 40)) for _ in range(r.randint(1, 8))), key=lambda f: (f.sqo, f.diag))
        path = chain.best_path(frags, P)
        assert path == sorted(path)
        assert path_score(frags, path, P) == brute_chain(frags, P)


def test_trimmed_chains_do_not_overlap():
    r = random.Random(4)
    for _ in range(200):
        frags = [Frag(r.randint(0, 200), 1000 + r.randint(0, 200), r.randint(15, 60)) for _ in range(r.randint(2, 9))]
        for clump in chain.chain_region(frags, 300, P):
            for a, b in zip(clump, clump[1:]):
                assert a.eqo < b.sqo and a.ero < b.sro and a.len > 0 and b.len > 0


def site(read, ref, start=0, stop=None):
    return Site(read, ref[start:stop], start, len(ref))


def sound(a, s, p=P):
    i, j = replay(a.ops, s.read[a.sqo :], s.ref(a.sro, s.seq_len))
    assert (a.eqo, a.ero) == (a.sqo + i - 1, a.sro + j - 1)
    assert a.ops[0][0] == a.ops[-1][0] == "M" and not needs_split(a.ops, p)
    m, n = sum(n for op, n in a.ops if op == "M"), sum(n for _, n in a.ops)
    assert m >= p.min_raw_score and m >= p.min_identity * n


@pytest.mark.parametrize(("rate", "share"), [(0.0, 0.99), (0.02, 0.8), (0.05, 0.4)])
def test_reads_come_back_to_their_place(rate, share):
    """From one seed alone; at a high error rate the band and the cut-off may end an extension early."""
    r = random.Random(5)
    ref = some(r, 5000)
    for _ in range(40):
        at = r.randint(0, 4000)
        read = mutated(r, ref[at : at + 600], rate)
        found = []
        for q in range(0, len(read) - 25):
            hit = ref.find(read[q : q + 25], max(0, at - 100), at + 800)
            if hit >= 0:
                found = align_clump([Frag(q, hit, 25)], site(read, ref), P)
                break
        assert found
        for a in found:
            sound(a, site(read, ref))
            assert abs(a.sro - a.sqo - at) < 60
        assert sum(a.eqo - a.sqo + 1 for a in found) > share * len(read)


def test_chain_over_an_insertion_and_a_deletion():
    r = random.Random(6)
    ref = some(r, 3000)
    read = ref[500:700] + some(r, 12) + ref[700:900] + ref[920:1100]
    frags = [Frag(0, 500, 200), Frag(212, 700, 200), Frag(412, 920, 180)]
    (a,) = align_clump(frags, site(read, ref), P)
    sound(a, site(read, ref))
    assert (a.sqo, a.eqo, a.sro, a.ero) == (0, len(read) - 1, 500, 1099)
    assert sum(n for op, n in a.ops if op == "I") - sum(n for op, n in a.ops if op == "D") == 12 - 20


def test_bad_middle_splits_into_sound_pieces():
    r = random.Random(7)
    ref = some(r, 2000)
    middle = bytes({65: 67, 67: 71, 71: 84, 84: 65}[b] for b in ref[300:340])
    read = ref[200:300] + middle + ref[340:440]
    whole = Alignment(0, 200, [["M", 100], ["R", 40], ["M", 100]])
    pieces = settled(whole, site(read, ref), P)
    assert len(pieces) == 2 and all(x.split for x in pieces)
    for x in pieces:
        sound(x, site(read, ref))
    assert core_of(whole.ops, P) == (0, 0)


def test_window_edges_are_noticed():
    from strandweave.operators.align import WindowTooSmall

    r = random.Random(8)
    ref = some(r, 1000)
    with pytest.raises(WindowTooSmall):
        align_clump([Frag(100, 500, 30)], site(ref[400:700], ref, 450, 560), P)
