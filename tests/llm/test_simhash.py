import random

import numpy as np
import xxhash

from strandweave.llm import queries, simhash
from strandweave.llm.common import connected_components


def brute_fp(text, k=4):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [(i, brute_fp(t)) for i, t in rows]
    u = sorted({f for _, f in fps})
    a = np.array(u, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = {}
    for s in range(len(u)):
        if s not in label:
            todo = [s]
            label[s] = s
            while todo:
                for y in np.flatnonzero(near[todo.pop()]):
                    if y not in label:
                        label[y] = s
                        todo.append(y)
    at = {f: label[i] for i, f in enumerate(u)}
    low = {}
    for i, f in fps:
        low[at[f]] = min(low.get(at[f], i), i)
    return sorted((i, f"{f:016x}", low[at[f]]) for i, f in fps)


def test_query_matches_brute_force(spark, sf_small, small_texts):
    assert sorted(map(tuple, queries.op2_simhash(spark, sf_small).select("doc_id", "fingerprint", "component_id").collect())) == brute(small_texts)


def test_odd_rows(make_docs, odd_rows):
    rows = [x for x in odd_rows if x[0] is not None]
    df = simhash.near_duplicates(make_docs(rows))
    assert sorted((i, f"{f & (2**64 - 1):016x}", c) for i, f, c in df.select("doc_id", "fp", "component_id").collect()) == brute(rows)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_links_at_every_distance(spark):
    r = random.Random(4)
    fps = []
    for _ in range(40):
        f = r.getrandbits(64)
        fps.append(f)
        for d in range(1, 7):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            fps.append(g)
    fps += [0, 15, 2**64 - 1, 2**63]
    u = np.unique(np.array(fps, np.uint64))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.array([label[near[i]].min() for i in range(len(u))])
    want = {(int(f), int(label[i])) for i, f in enumerate(u) if near[i].sum() > 1}
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    at = {int(f): int(label[i]) for i, f in enumerate(u)}
    got = {n & (2**64 - 1): root & (2**64 - 1) for n, root in simhash.link_fingerprints(df).collect()}
    assert set(got) == {f for f, _ in want}
    groups = {}
    for f, root in got.items():
        groups.setdefault(root, set()).add(at[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({g for _, g in want})


def test_dense_ball_is_split(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_VARIANTS", 500)
    r = random.Random(9)
    fps = np.array([r.getrandbits(20) for _ in range(300)], np.uint64)
    links = simhash.ball_links(fps, 0, 4, 2)
    u = np.unique(fps)
    assert all(np.bitwise_count(a ^ b) <= 64 for a, b in links)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(u))
    for _ in range(40):
        label = np.array([label[near[i]].min() for i in range(len(u))])
    mine = {int(f): int(f) for f in u} | {int(a): int(b) for a, b in links}
    assert len(set(mine.values())) == len(set(label.tolist()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    df = spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")
    for one_task in (500_000, 0):
        got = dict(map(tuple, connected_components(df, one_task=one_task).collect()))
        assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(500)) and len(got) == 701


def test_near_copies_down_to_a_similarity_of_four_fifths(make_docs, odd_rows):
    from support import brute_components

    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for family in range(60):
        base = [r.choice(words) for _ in range(r.randint(40, 300))]
        rows.append((10 * family, " ".join(base)))
        for c in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((10 * family + 1 + c, " ".join(w)))
    rows += [(-i, t) for i, t in odd_rows if i is not None and i != 5]
    groups = {}
    for d, c in simhash.near_copies(make_docs(rows)).collect():
        groups.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute_components(rows, 5)))
    assert all(c == min(g) for c, g in groups.items())
    assert simhash.near_copies(make_docs([])).count() == 0


def test_band_keys_do_not_depend_on_order():
    a = np.array([random.Random(1).getrandbits(64) for _ in range(9000)], np.uint64)
    assert (simhash.band_keys(a) == simhash.band_keys(a[::-1])).all() and len(simhash.band_keys(a[:0])) == 0


def star(r, words, copies, changes, length=200):
    """A text and copies of it, each with its own words put in at random places."""
    base = [r.choice(words) for _ in range(length)]
    texts = []
    for c in range(copies):
        w = list(base)
        for i, at in enumerate(r.sample(range(length), changes)):
            w[at] = f"new{c}x{i}"
        texts.append(" ".join(w))
    return " ".join(base), texts


def test_near_copies_of_large_stars_and_of_families_that_share_keys(make_docs):
    from support import brute_components

    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for at, (copies, changes) in enumerate([(300, 4), (200, 3)]):
        base, texts = star(r, words, copies, changes)
        # the original's id lies between its copies' ids
        rows += [(1000 * at + i, t) for i, t in enumerate(texts[: copies // 2] + [base] + texts[copies // 2 :])]
    frame = [r.choice(words) for _ in range(200)]
    for family in range(30):
        base = list(frame)
        for at in range(0, 200, 25):
            base[at] = f"f{family}x{at}"
        for c in range(3):
            w = list(base)
            for i in range(c * 3):
                w[r.randrange(200)] = f"f{family}c{c}x{i}"
            rows.append((9000 - len(rows), " ".join(w)))
    groups = {}
    for d, c in simhash.near_copies(make_docs(rows)).collect():
        groups.setdefault(c, set()).add(d)
    want = sorted(map(sorted, brute_components(rows, 5)))
    assert 3 < len(want) < len(rows)
    assert sorted(map(sorted, groups.values())) == want


def test_near_copies_with_equal_sets_and_far_fingerprints(make_docs):
    r = random.Random(23)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    while len(rows) < 20:
        x, y = ([r.choice(words) for _ in range(n)] for n in (30, 60))
        one, two = " ".join(x + x + y), " ".join(x + x + x + y)
        if (simhash.fingerprint_bytes(one.encode(), 5) ^ simhash.fingerprint_bytes(two.encode(), 5)).bit_count() > 4:
            rows += [(len(rows), one), (len(rows) + 1, two)]
    assert sorted(map(tuple, simhash.near_copies(make_docs(rows)).collect())) == [(i, i - i % 2) for i in range(20)]
