import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "score"}


def test_every_engine_query_has_sql():
    from skeinrank.plans import queries

    assert set(queries.QUERIES) == set(queries.ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["search_two_terms", "search_tenant", "search_batch_topk", "score_all_rows", "fieldnorm_lengths", "precision_at_k"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(object)
    assert order(got).equals(order(want)) or (order(got) == order(want)).all().all()


@pytest.mark.parametrize("gone", [("skeinrank/llm", "tests/llm"), ("skeinrank/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_the_optional_parts(tmp_path, gone):
    """A copy of everything without the optional folders (and the pipeline file) imports, and its queries are the engine's."""
    for p in ROOT.iterdir():
        if not p.name.startswith("."):
            subprocess.run(["cp", "-r", str(p), str(tmp_path / p.name)], check=True)
    for p in gone:
        subprocess.run(["rm", "-rf", str(tmp_path / p)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_two_terms' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, stdout=subprocess.DEVNULL)
