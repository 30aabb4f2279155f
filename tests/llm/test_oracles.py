"""SQL and Spark on the small tables, and on tables that hold what those lack."""

import duckdb
import pytest

from strandweave.llm import queries


def compare(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet{'/*.parquet' if 'sf0' not in path else ''}')")
    rel = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, path)
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    a, b = (sorted(repr(tuple(r[c] for c in cols)) for r in rows) for rows in ([r.asDict() for r in got.collect()], want))
    assert a == b and a


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_small_tables(spark, sf_small, name):
    compare(spark, sf_small, name)


def test_tables_with_quotes_and_leaks(spark, make_docs, tmp_path):
    import random

    from test_decontamination import cases

    _, _, docs, bench = cases(spark, make_docs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.drop("doc_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(7)
    words = "alpha beta gamma delta epsilon".split()
    rows = []
    for conv in range(120):
        texts = []
        for turn in range(r.randint(1, 9)):
            t = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 4)))
            for _ in range(r.randint(0, 2) if texts else 0):
                quoted = "\n".join(r.choice(["> ", ">", " > ", ">> ", "> > ", "    >"]) + x.upper() for x in r.choice(texts).split("\n"))
                t = quoted + r.choice(["\n", "\n\n\n\n", "\r\n"]) + t
            texts.append(t)
            rows.append((conv, turn, r.choice(["user", "assistant", None]), r.choice([t] * 9 + [None])))
            if r.random() < 0.05:
                rows.append(rows[-1])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name in queries.ORACLE_SQL:
        compare(spark, str(tmp_path), name)
