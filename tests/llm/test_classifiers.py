"""Quality classifier and toxicity: held-out accuracy, edge cases, and what must not leak."""

import zlib

import numpy as np
import pandas as pd

from strandweave.llm import quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.01"


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_classifier(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet"))
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark)
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, other)
    assert np.array_equal(a.bucket_scores, b.bucket_scores) and a.offset == b.offset


def test_quality_odd_rows(spark, make_docs, odd_rows):
    docs, labels = tables(spark)
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score_documents(make_docs(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {round(r["score"], 12) for r in got if r["doc_id"] in (1, 2, 3, 8, 12)}
    assert len(blank) == 1
    assert quality_classifier.score_documents(make_docs([]), model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert all(r["score"] == 0.5 for r in quality_classifier.score_documents(make_docs([(1, None), (2, "a b")]), none).collect())


def test_scores_equal_the_plain_model():
    texts = ["good words here", "bad bad bad", "", None, "good good"]
    model = quality_classifier.train(texts * 20, np.array([1, 0, 0, 0, 1] * 20))
    for t, s in zip(texts, model.scores(texts)):
        words = quality_classifier.words_of(t)
        z = model.offset
        if words:
            index, buckets = quality_classifier.word_features(words)
            means = np.bincount(index, model.bucket_scores[buckets]) / np.bincount(index)
            bigrams = quality_classifier.bigram_buckets(np.array([zlib.crc32(w) for w in words]))
            z += (means.sum() + model.bucket_scores[bigrams].sum()) / (len(means) + len(bigrams))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    assert model.scores(["good words"])[0] > model.scores(["bad bad"])[0]


def test_toxic_documents(spark):
    found = queries.op6_toxicity(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    hit = labels["doc_id"].isin(found["doc_id"])
    toxic = labels["toxic"] == 1
    assert hit[toxic].mean() > 0.75 and hit[~toxic].mean() < 0.03


def test_toxicity_generalises(spark):
    docs, labels = tables(spark)
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score_documents(docs, chain).toPandas().merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id", suffixes=("", "_label"))
    hit = got["toxic"] >= toxicity.THRESHOLD
    assert hit[got["toxic_label"] == 1].mean() > 0.6 and hit[got["toxic_label"] == 0].mean() < 0.04


def test_toxicity_odd_rows(spark, make_docs, odd_rows):
    docs, labels = tables(spark)
    chain = toxicity.fit(docs, labels)
    got = toxicity.score_documents(make_docs(odd_rows), chain).collect()
    assert len(got) == len(odd_rows) and all(r["toxic"] < 0.5 for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.toxic_documents(make_docs(odd_rows), labels.limit(0)).count() == 0
    assert toxicity.score_documents(make_docs([]), chain).count() == 0


def chain_of(x, labels, folds=5):
    return toxicity.train_chain(x, labels, np.arange(len(x)) % folds, np.ones((folds, x.shape[1]), bool), {f"w{i}": i for i in range(x.shape[1])})


def dense(x):
    return [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    first = (x[:, 0] > 0.5).astype(float)
    chain = chain_of(x, np.column_stack([first, first]))
    assert [len(w) for w in chain.weights] == [4, 5] and chain.weights[1][-1] > 0
    p = chain.probabilities(dense(x))
    assert p.shape == (400, 2) and ((p > 0.5).T == first).mean() > 0.95


def test_texts_without_words_count_as_often_as_they_are():
    x = np.zeros((300, 2))
    x[:60, 0] = 1
    y = np.r_[np.ones(50), np.zeros(250)][:, None]
    p = chain_of(x, y).probabilities(dense(np.array([[1.0, 0], [0, 0]])))[:, 0]
    assert p[0] > 0.7 and p[1] < 0.05


def test_last_link_decides_and_needs_the_links_before_it(spark):
    docs, labels = tables(spark)
    chain = toxicity.fit(docs, labels)
    n = len(chain.vocabulary)
    assert toxicity.CATEGORIES[-1] == "toxic" and (chain.weights[-1][1 + n :] != 0).any()
    cut = toxicity.Chain(chain.vocabulary, [*chain.weights[:-1], np.r_[chain.weights[-1][: 1 + n], np.zeros(len(chain.weights) - 1)]])
    found = {c: {r[0] for r in toxicity.score_documents(docs, m).where(f"toxic >= {toxicity.THRESHOLD}").select("doc_id").collect()} for c, m in (("chain", chain), ("cut", cut))}
    assert found["chain"] > found["cut"] and len(found["chain"]) > 1.2 * len(found["cut"])


def test_a_word_counts_once_however_many_beginnings_match():
    chain = toxicity.Chain({"lowe*": 0, "lowei*": 1, "loweiab": 2}, [np.array([0.0, 1, 1, 1])])
    at, x = chain.sparse("loweiab loweiab other")
    assert dict(zip(at, np.expm1(x).round(9))) == {0: 2, 1: 2, 2: 2}
