import random
from collections import Counter

import corpus_pipeline as pipeline
from strandweave.llm import secret_scan
from support import brute_components

SF = "/root/testdata/sf0.01"


def test_stages_decide_as_their_operators_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, kept, SF).write.mode("overwrite").parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert kept.columns == docs.columns
        seen[name] = (before, kept)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {n: ({r[0] for r in a.select("doc_id").collect()}, {r[0] for r in b.select("doc_id").collect()}) for n, (a, b) in seen.items()}
    assert all(b <= a for a, b in ids.values())
    # of each group of near copies, the smallest id stays
    before, after = ids["near_duplicates"]
    groups = brute_components([(i, texts[i]) for i in before], pipeline.SHINGLE_WORDS)
    assert after == {min(g) for g in groups}
    # no document that is kept holds a benchmark item
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in (texts[i] or "") for i in ids["decontamination"][1] for x in items)
    # the same documents, with secrets replaced
    before, after = seen["secret_scan"]
    model = secret_scan.fit()
    now = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(now) == ids["decontamination"][1]
    for i, t in now.items():
        spans = secret_scan.judged(texts[i] or "", model, secret_scan.THRESHOLD)
        want = texts[i]
        for a, b, _ in reversed(spans):
            want = want[:a] + "[SECRET]" + want[b:]
        assert t == want
    rows = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in rows} == set(now)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pipeline.run(spark, SF).collect())) and max(Counter(r["sequence_id"] for r in rows).values()) >= 1


def test_stages_on_awkward_tables(spark, make_docs, odd_rows):
    for rows in (odd_rows, []):
        docs = make_docs(rows).drop("component_id", "rank")
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.collect()
        kept = pipeline.near_duplicates(spark, docs, "")
        assert kept.where("doc_id is null").count() == sum(r[0] is None for r in rows)


def test_rows_without_an_id_and_rows_that_share_one(spark, make_docs):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red orange yellow green blue violet")
    rows = [(None, a), (None, b), (None, c), (1, a), (1, b), (2, a), (3, c), (3, c), (4, None), (4, None), (None, None)]
    kept = pipeline.near_duplicates(spark, make_docs(rows), "")
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted([(None, a), (None, b), (None, c), (None, None), (1, a), (1, b), (3, c), (4, None)], key=key)


def test_columns_with_names_that_stages_use(spark, make_docs):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    texts = [prose(120) for _ in range(6)]
    rows = list(enumerate([*texts, texts[0], texts[1] + " more", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + prose(90)]))
    docs = make_docs(rows)
    for c in ("score", "kept", "id", "name", "set", "key", "node", "group", "hs", "item_id", "length", "piece", "start", "ids"):
        docs = docs.withColumn(c, docs["lang"])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {x["doc_id"] for x in out.collect()} == ({0, 1, 2, 3, 4, 5, 8} if name == "near_duplicates" else set(range(9))), name
    assert pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == 9
