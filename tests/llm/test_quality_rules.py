import re
from collections import Counter

import numpy as np

from strandweave.llm import queries, quality_rules
from strandweave.llm.trees import boost, random_forest

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def check(rows, text):
    for r in rows:
        want = brute(text[r["doc_id"]])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_query_matches_brute_force(spark, sf_small, small_texts):
    rows = queries.op4_quality_rules(spark, sf_small).collect()
    assert len(rows) == len(small_texts)
    check(rows, dict(small_texts))


def test_odd_rows(make_docs, odd_rows):
    rows = quality_rules.apply_rules(make_docs(odd_rows), None).collect()
    check(rows, dict(odd_rows))
    assert len(rows) == len(odd_rows)
    assert quality_rules.apply_rules(make_docs([]), None).count() == 0


def test_keeps_columns_and_good_documents(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    joined = labels.where("quality = 1").join(docs, "doc_id")
    assert joined.join(kept.select("doc_id"), "doc_id").count() >= 0.9 * joined.count()


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "good words here " * 5), (2, None)])
    assert quality_rules.fit(docs, none) is None
    assert quality_rules.keep_documents(docs, none).count() == 0


def test_boosting_obeys_monotone_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    model = boost(x, y, np.array([1, -1, 0]))
    base = rng.random((60, 3))
    for f, sign in ((0, 1), (1, -1)):
        steps = np.repeat(base[:, None], 30, 1)
        steps[:, :, f] = np.linspace(0, 1, 30)
        s = model.scores(steps.reshape(-1, 3)).reshape(60, 30)
        assert (sign * np.diff(s, axis=1) >= -1e-9).all()
    assert ((model.scores(x) > 0) == y).mean() > 0.9


def test_forest_learns_and_scores_alike_in_any_batch():
    rng = np.random.default_rng(1)
    x = rng.random((600, 5))
    y = (x[:, 2] > 0.5).astype(float)
    model = random_forest(x, y)
    s = model.scores(x)
    assert ((s > 0.5) == y).mean() > 0.95
    assert np.allclose(np.concatenate([model.scores(x[i : i + 7]) for i in range(0, 600, 7)]), s)


def test_columns_with_names_of_its_own(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, " ".join(f"word{i}" for i in range(80))), (None, " ".join(f"w{i}" for i in range(80))), (2, "short"), (3, None)])
    for c in ("score", "kept", "n_words", "base_failed", "strandweave_id", "set", "key", "node", "hs", "length", "sequence_id"):
        docs = docs.withColumnRenamed("rank", c) if "rank" in docs.columns else docs.withColumn(c, docs["lang"])
    kept = quality_rules.keep_documents(docs, none)
    assert kept.columns == docs.columns and sorted(map(str, kept.select("doc_id", "score").collect())) == sorted(map(str, docs.where("length(text) > 100").select("doc_id", "score").collect()))


def test_repeated_ids_and_labels_train_once(spark, make_docs):
    docs = make_docs([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    got = quality_rules.training_rows(docs, labels, "quality", 10).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1.0), (2, "c", 0.0), (2, "c", 1.0)]
