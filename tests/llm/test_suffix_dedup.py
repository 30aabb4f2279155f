import hashlib
import random

import numpy as np
import pytest

from strandweave.llm import queries, suffix_dedup


def brute(rows, window=50):
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows if i is not None]
    for i, t in texts:
        for a in range(len(t) - window + 1):
            s = t[a : a + window]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - window + 1):
            if first[t[a : a + window]] < i:
                gone[a : a + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def test_query_matches_brute_force(spark, sf_small, small_texts):
    assert got(queries.op1_suffix_dedup(spark, sf_small)) == brute(small_texts)


def test_repetitive_and_overlapping_texts(make_docs):
    r = random.Random(3)
    some = lambda n, chars="ab ": "".join(r.choice(chars) for _ in range(n))
    parts = [some(60, "abcdefghij ") for _ in range(8)] + ["a" * 70, "ab" * 40, "é" * 40]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.7 else some(r.randint(1, 30)) for _ in range(r.randint(1, 8)))) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(-5, rows[3][1][7:90])]
    assert got(suffix_dedup.deduplicate(make_docs(rows, 5))) == brute(rows)


def test_odd_rows(make_docs, odd_rows):
    assert got(suffix_dedup.deduplicate(make_docs([x for x in odd_rows if not x[1] or len(x[1]) < 1000 or x[0] == 6]))) == brute([x for x in odd_rows if not x[1] or len(x[1]) < 1000 or x[0] == 6])
    full = {r[0]: r for r in got(suffix_dedup.deduplicate(make_docs(odd_rows)))}
    assert full[10][2] == 0 and full[9][1] == 80_000


def test_empty_table(make_docs):
    assert got(suffix_dedup.deduplicate(make_docs([]))) == []


def test_bucket_pointer_refinement_sorts_like_suffixes():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        text = bytes(r.choice(b"ab") for _ in range(n))
        for depth in (2, 3, 7, 50):
            bucket = suffix_dedup.bucket_pointer_refinement(np.frombuffer(text, np.uint8), depth)
            want = [text[i : i + depth] for i in range(n)]
            order = sorted(set(want))
            counts = np.cumsum([0] + [want.count(w) for w in order])
            assert bucket.tolist() == [counts[order.index(w)] for w in want]


@pytest.mark.parametrize("keep", [True, False])
def test_kept_text(make_docs, keep):
    rows = [(1, "q" * 60), (2, "start " + "q" * 60 + " end")]
    df = suffix_dedup.deduplicate(make_docs(rows), keep_text=keep)
    assert ("kept_text" in df.columns) == keep
    if keep:
        assert {r["doc_id"]: r["kept_text"] for r in df.collect()}[2] == "start  end"
