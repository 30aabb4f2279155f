import hashlib
import random
import re

import numpy as np
import pandas as pd

from strandweave.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(PATTERNS)


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in (text or ""):
            continue  # the plain pattern takes the square of a long word's length
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    by = {}
    for i, t in texts:
        by.setdefault(i, brute(t))
    for r in rows:
        want = by[r["doc_id"]]
        assert r["base"] == told(want), r["doc_id"]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_query_matches_brute_force(spark, sf_small, small_texts):
    rows = queries.op7_pii(spark, sf_small).collect()
    text = dict(small_texts)
    assert len(rows) == len(small_texts)
    for r in rows:
        want = brute(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == n for x in want) for n in range(4)]


def test_larger_table(spark):
    path = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{path}/documents.parquet")
    check(pii.find_spans(spark.read.parquet(f"{path}/documents.parquet")).collect(), list(zip(d["doc_id"], d["text"])))


def test_awkward_texts(make_docs, odd_rows):
    r = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x_y@d-e.f.g", "1.2.3.4", "256.1.1.1", "0000255.1.1.01", "1.2.3.4.5.6.7.8", "+1 (650) 253-0000", "+", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111 ", " ", "\n", "é", "😀", "00", "-", "+49 30 1234567", "555-123-4567", "bob [at] host [dot] com", "(212) 555-0101", "call ", "isbn "]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))) for i in range(800)] + [(1000 + i, t) for i, t in enumerate(x[1] for x in odd_rows)]
    rows += [(2000, "1" * 100_000), (2001, "1 " * 50_000), (2002, "a" * 20_000 + "@"), (2003, "1." * 50_000), (2004, "+1" + "2-" * 50_000)]
    check(pii.find_spans(make_docs(rows)).collect(), rows)
    assert pii.find_spans(make_docs([])).count() == 0


def test_reliabilities_are_recovered():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.4
    votes = np.stack([np.where(r.random(20_000) < acc, truth, ~truth).astype(int) for acc in (0.95, 0.8, 0.7)], 1)
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    post, tables = pii.estimate(distinct, counts.astype(float))
    for j, acc in enumerate((0.95, 0.8, 0.7)):
        assert abs(tables[j][1][2] - acc) < 0.05 and abs(tables[j][0][1] - acc) < 0.05


def test_loose_forms_with_cues_are_added(spark, make_docs):
    rows = [(i, f"please call me on phone (212) 555-{i:04d} or mail bob{i} [at] mail [dot] com") for i in range(200)]
    rows += [(500 + i, f"write to e-mail ann{i}@mail.com, call +1 212 555 {i:04d} today") for i in range(400)] + [(2000 + i, f"order 404-123-{i:04d} of invoice section {i}") for i in range(300)]
    out = {r["doc_id"]: r for r in pii.find_spans(make_docs(rows)).collect()}
    assert sum("phone" in out[i]["spans"] or "email" in out[i]["spans"] for i in range(200)) > 150
    assert all(out[500 + i]["n_email"] == 1 and out[500 + i]["n_phone"] == 1 for i in range(400))


def test_plan_has_no_python(spark, sf_small):
    plan = queries.op7_pii(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
