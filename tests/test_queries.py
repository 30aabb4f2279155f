"""Every query with SQL against DuckDB, on the smallest tables; the others by what must hold."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from strandweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def plain(rows, cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_small, name):
    got = registry.QUERIES[name](spark, sf_small)
    rel = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert plain([r.asDict() for r in got.collect()], cols) == plain(want, cols)


def test_reported_alignments_hold(spark, sf_small):
    from strandweave.plans.fixtures import reads, sequences

    text = {r["query_id"]: r["seq"] for r in reads(spark, sf_small).collect()}
    refs = {r["seq_id"]: r["seq"] for r in sequences(spark, sf_small).collect()}
    found = registry._stages(spark, sf_small).selected.collect()
    assert found
    for r in found:
        read = text[r["query_id"]]
        if r["strand"] == "-":
            read = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
        i, j = r["sqo"], r["sro"]
        for o in r["ops"]:
            if o["op"] == "M":
                assert read[i : i + o["len"]] == refs[r["seq_id"]][j : j + o["len"]]
            i += o["len"] if o["op"] != "D" else 0
            j += o["len"] if o["op"] != "I" else 0
        assert (i - 1, j - 1) == (r["eqo"], r["ero"]) and r["ref"] == refs[r["seq_id"]][r["sro"] : r["ero"] + 1]
        assert r["status"] & 0x20 and 0 <= r["mapq"] <= 250 and 1 <= r["primary_ix"] <= r["n_primaries"]


def test_statistics_add_up(spark, sf_small):
    s = registry.run_stats(spark, sf_small).first()
    assert s["n_unaligned"] == registry.unaligned_reads(spark, sf_small).count()
    assert s["n_reads"] == registry.reads(spark, sf_small).count()


def test_entry_points_without_the_training_data_folder(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
