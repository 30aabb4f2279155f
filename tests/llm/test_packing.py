import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandweave.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check(rows, texts, tokenizer, capacity=4096, slack=0.02):
    by_doc, by_seq, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(p, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == want, doc
        total += len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_seq) <= np.ceil(total / capacity) * (1 + slack) + 1


def test_query(spark, sf_small, small_texts, tokenizer):
    check(queries.op8_packing(spark, sf_small).collect(), small_texts, tokenizer)


def test_odd_rows(make_docs, odd_rows, tokenizer):
    rows = [x for x in odd_rows if x[0] not in (5, None)]
    rows += [(20, "<|endoftext|> a<|startoftext|>b"), (21, "Don't STOP, 3.5% naïve ÀÉ ﬁ ǅ 中文 мир İ ß ﬀ K"), (22, "é x y z a.́ .. ,. a., it's'"), (23, "x" * 30_000 + ", yes.")]
    check(packing.pack_documents(make_docs(rows)).collect(), rows, tokenizer)
    assert packing.pack_documents(make_docs([])).count() == 0
    assert packing.pack_documents(make_docs([(5, "one"), (5, "one"), (None, "x")])).count() == 3


def test_word_cache_is_the_tokenizer(tokenizer):
    r = random.Random(2)
    chars = "abcXYZéßÀµªº.,;'!? \n\t\r<|>0129-_中м́ ​İ"
    cache = packing.WordCache(packing.default_tokenizer())
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t, ids in zip(texts, cache.encode(texts)):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def brute_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= lengths[i]:
                bins[b] -= lengths[i]
                go(i + 1, bins)
                bins[b] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_local_search_is_near_the_optimum():
    r = random.Random(5)
    for _ in range(60):
        lengths = sorted((r.randint(1, 20) for _ in range(9)), reverse=True)
        counts = defaultdict(int)
        for x in lengths:
            counts[x] += 1
        groups = packing.local_search(packing.best_fit_groups(dict(counts), 20), 20)
        assert sum(g[0] for g in groups) <= brute_bins(lengths, 20) + (0 if len(lengths) < 9 else 1)
        placed = defaultdict(int)
        for m, free, items in groups:
            assert free == 20 - sum(x * k for x, k in items.items()) >= 0
            for x, k in items.items():
                placed[x] += m * k
        assert placed == counts


def test_exchange_empties_a_bin():
    groups = [[1, 3, {4: 1, 3: 1}], [1, 3, {5: 1, 2: 1}], [1, 4, {6: 1}]]
    assert sum(g[0] for g in packing.local_search(groups, 10)) == 2


def test_plan_covers_every_rank():
    counts = {4096: 7, 3000: 100_003, 1000: 55_001, 96: 300_000, 1: 12}
    runs = packing.plan_runs(counts)
    for length, n in counts.items():
        own = runs["length"] == length
        assert runs["rank0"][own].min() == 0 and (np.diff(runs["rank0"][own]) > 0).all() and runs["rank0"][own].max() < n
