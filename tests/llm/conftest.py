import pandas as pd
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, rank string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with two more columns whose names clash with ones that operators make."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "web", None if t is None else len(t), "x", None) for i, t in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def small_texts(sf_small):
    d = pd.read_parquet(f"{sf_small}/documents.parquet")
    return list(zip(d["doc_id"].tolist(), d["text"].tolist()))


#: Nulls, blanks, ties, repeated rows and long texts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "w " * 30_000), (7, "é" * 120), (8, "\n" * 99),
    (9, "ab" * 40_000), (10, "x" * 200_000), (None, "no id at all, but a text"), (12, None),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
