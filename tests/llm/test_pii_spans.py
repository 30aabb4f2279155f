"""The proposed spans by brute force: the same patterns and words by another engine, loops instead of expressions."""

import random

import numpy as np
import pandas as pd
import pytest
import regex

from strandweave.llm import pii
from test_pii import brute as base_spans

NAMES = list(pii.ALL_KINDS)


def luhn(text):
    d = [int(c) for c in reversed(text) if c.isdigit()]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def signs(text, span):
    s, k, e, strict = span
    m, left, right = text[s:e], text[max(0, s - pii.CONTEXT) : s], text[e : e + pii.CONTEXT]
    digits = regex.sub("[^0-9]", "", m)
    check = 0
    if NAMES[k] == "card":
        check = 1 if luhn(m) else -1
    elif NAMES[k] == "phone":
        check = 1 if 10 <= len(digits) <= 15 else -1
    elif NAMES[k] == "ip":
        check = 1 if all(int(p) <= 255 for p in m.replace("[.]", ".").split(".")) else -1
    against = int(bool(regex.search(pii._AGAINST, left + " " + right)))
    return dict(shape=int(strict), check=check, place=int(bool(regex.search(pii._PLACES[k].replace("\\\\", "\\"), m))), cue=int(bool(regex.search(pii._CUES[k].replace("\\\\", "\\"), left))), against=against, start=int(bool(regex.search(r"[:=(]\s*$", left))))




def proposals(text):
    out = []
    for n, (kind, pattern, _, strict) in enumerate(pii._PROPOSALS):
        for m in regex.finditer(pattern, text):
            out.append((m.start(), NAMES.index(kind), m.end(), strict, n))
    return out


def expected(rows):
    """doc_id -> spans, with the classifier trained on the counts of this table."""
    table, per = {}, {}
    for i, t in rows:
        text = t or ""
        base = [(s, k, e, True) for s, k, e in base_spans(text)]
        loose = [x[:4] for x in proposals(text)]
        per[i] = []
        for x in base + loose:
            c = signs(text, x)
            vote = dict(v_shape=c["shape"], v_check=c["check"], v_gazetteer=c["place"], v_context=c["cue"], v_against=-c["against"])
            feat = {f"f_{n}": c[n] for n in ("shape", "check", "cue", "against", "place", "start")} | {f"f_{n}_word": c[n] * (x[1] > 3) for n in ("cue", "place")} | {f"f_{k}": int(x[1] == j) for j, k in enumerate(NAMES) if j}
            row = vote | feat
            key = tuple(row[n] for n in (*pii.LABELERS, *pii.FEATURES))
            table[key] = table.get(key, 0) + 1
            per[i].append((x, feat))
        per[i] = (base, per[i][len(base) :])
    weights = pii.train([dict(zip((*pii.LABELERS, *pii.FEATURES), k)) | {"count": n} for k, n in table.items()])
    out = {}
    for i, (base, loose) in per.items():
        taken = []
        for x, feat in loose:
            z = weights[0] + sum(w * feat[f] for w, f in zip(weights[1:], pii.FEATURES))
            if z >= np.log(pii.THRESHOLD / (1 - pii.THRESHOLD)):
                taken.append(x)
        every = sorted([(s, e, False, k) for s, k, e, _ in base] + [(s, e, True, k) for s, k, e, _ in taken])
        kept = [(s, k, e) for n, (s, e, new, k) in enumerate(every) if not new or not any(b > s for _, b, _, _ in every[:n]) and not any(not new2 and a < e for a, _, new2, _ in every[n + 1 :])]
        out[i] = ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in sorted(kept))
    return out


def made(n=400):
    r = random.Random(8)
    pieces = [
        "call me on phone (212) 555-0143 now", "mail bob [at] mail [dot] com", "+1 (605) 555-9305 4078918989542222", "126.1.2.3 4880761348116108", "My name is Ada King.", "Dr. Petra Sommer was here", "James Watt met Mary Shelley",
        "order 404-123-4567 of invoice section 3", "lives at 12 Long Hill Road", "wohnt Hauptstraße 17", "12, rue de la Paix", "born on 12 March 1984", "updated 2020-01-02", "version 03/04/2019", "write to ann@mail.com", "server 10.0.0.1", "and so on", "The House of Ways", "10[.]1[.]2[.]3", "4111 1111 1111 1111", "1234567890123456",
    ]
    return [(i, "x ".join(r.sample(pieces, r.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("source", ["made", "table"])
def test_spans_match_brute_force(spark, make_docs, source):
    if source == "made":
        rows = made()
        docs = make_docs(rows)
    else:
        path = "/root/testdata/sf0.01/documents.parquet"
        d = pd.read_parquet(path)
        rows, docs = list(zip(d["doc_id"].tolist(), d["text"].tolist())), spark.read.parquet(path)
    want = expected(rows)
    got = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert {i: r["spans"] for i, r in got.items()} == want
    assert all(r["n_spans"] == (len(r["spans"].split(",")) if r["spans"] else 0) for r in got.values())
    # the labelers add spans that the base patterns lack
    added = [i for i, r in got.items() if r["spans"] != r["base"]]
    assert len(added) > (50 if source == "made" else -1)


def test_reliabilities_change_what_is_taken(spark, make_docs):
    rows = made()
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(make_docs(rows)).collect()}
    joined = ",".join(got.values())
    assert all(f"{k}:" in joined for k in ("name", "address", "birth", "phone", "card"))
    text = dict(rows)
    dates = [i for i in got if "updated 2020-01-02" in text[i] and "born" not in text[i] and "03/04" not in text[i]]
    assert dates and not any("birth" in got[i] for i in dates)


def test_many_matches_in_one_text(spark, make_docs):
    n = 2000
    rows = [(1, " ".join(f"a{i}@b.com" for i in range(n))), (2, " ".join("My name is Ada King." for _ in range(n)))]
    got = {r["doc_id"]: r for r in pii.find_spans(make_docs(rows)).collect()}
    assert got[1]["n_email"] == n and got[1]["base"].split(",")[-1].split(":")[2] == str(len(rows[0][1]))
