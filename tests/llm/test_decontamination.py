import random

from strandweave.llm import decontamination, queries

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(3, 9))) for _ in range(4000)]


def prose(n, r):
    return [r.choice(WORDS) for _ in range(n)]


def tokens(text):
    import re

    return re.sub("[" + re.escape(decontamination.MARKS) + "]", "", (text or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")).split(" ")


def brute(docs, items):
    """Pairs and best figures over every alignment that a seed can fix: here, over every alignment at all."""
    out = set()
    for d, text in docs:
        a = [t for t in tokens(text) if t]
        for k, item in items:
            b = [t for t in tokens(item) if t]
            for shift in range(-len(b) + 1, len(a) if b else -len(b)):
                same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
                run = best = 0
                for s in same:
                    run = max(0, run + (1 if s else -4))
                    best = max(best, run)
                if 100 * sum(same) >= 80 * len(b) or best >= 13:
                    out.add((d, k))
    return out


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def cases(spark, make_docs):
    r = random.Random(1)
    items = [(k, " ".join(prose(r.randint(14, 60), r))) for k in range(25)] + [(90, "too few words"), (91, None), (92, ""), (93, " ".join(prose(6, r)))]
    docs = []
    for i in range(120):
        body = prose(r.randint(20, 200), r)
        if i % 3 == 0:
            hit = items[r.randrange(25)][1].split()
            if i % 2:
                for _ in range(len(hit) // 10):
                    hit[r.randrange(len(hit))] = r.choice(WORDS)
            if i % 5 == 0:
                hit = hit[: r.randint(8, len(hit))]
            at = r.randrange(len(body))
            body[at:at] = [w.upper() if i % 4 == 0 else w + "," for w in hit]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, items[28][1]), (504, "w " * 20_000 + items[3][1]), (None, items[4][1])]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items] + [(None, items[0][1], "x")], "item_id long, text string, doc_id string")
    return docs, items, make_docs(docs), bench


def test_matches_brute_force_by_both_ways(spark, make_docs):
    docs, items, df, bench = cases(spark, make_docs)
    want = brute([d for d in docs if d[0] is not None], items)
    assert len(want) > 30
    assert pairs(decontamination.contaminated_pairs(df, bench)) == want
    assert pairs(decontamination.contaminated_pairs(df, bench, broadcast_tokens=0)) == want


def test_filter_keeps_clean_rows_with_their_columns(spark, make_docs):
    docs, items, df, bench = cases(spark, make_docs)
    bad = {d for d, _ in brute([d for d in docs if d[0] is not None], items)}
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, _ in docs if d is not None and d not in bad)
    assert kept.where("doc_id is null").count() == 1
    assert decontamination.decontaminate(df, bench.limit(0)).count() == df.count()
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0


def test_query_finds_verbatim_items(spark, sf_small):
    found = pairs(queries.op3_decontamination(spark, sf_small))
    import pandas as pd

    d, b = pd.read_parquet(f"{sf_small}/documents.parquet"), pd.read_parquet(f"{sf_small}/benchmark.parquet")
    want = {(i, k) for i, t in zip(d["doc_id"], d["text"]) for k, x in zip(b["item_id"], b["text"]) if x in (t or "")}
    assert want and want <= found


def test_plan_has_no_python(spark, sf_small):
    df = queries.op3_decontamination(spark, sf_small)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_every_allowed_substitution_leaves_a_seed():
    from itertools import combinations

    for n in range(1, decontamination.SHORT + 1):
        masks = [m for m, length in decontamination.EVERY_MASK if length in (0, n)]
        on = [[s + i for i, c in enumerate(m) if c == "1"] for m in masks for s in range(n - len(m) + 1)]
        assert all(any(set(c).isdisjoint(o) for o in on) for c in combinations(range(n), n // 5)), n


def test_short_items(spark, make_docs):
    r = random.Random(6)
    items, docs = [], []
    for n in range(1, 15):
        item = prose(n, r)
        items.append((n, " ".join(item)))
        for k in range(12):
            hit = list(item)
            for at in r.sample(range(n), min(n, n // 5 + (k % 4 == 3))):
                hit[at] = "other"
            docs.append((100 * n + k, " ".join(prose(30, r) + hit + prose(30, r))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = pairs(decontamination.contaminated_pairs(make_docs(docs), bench))
    assert got == brute(docs, items) and {k for _, k in got} == set(range(1, 15))
