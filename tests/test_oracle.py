import pytest
from oracle import connect, same

from kinfold.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    same(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLE[name])


def test_subsample_fills_its_production_budget(spark):
    folder = "/root/testdata/sf0.1"
    same(spark, connect(folder), folder, catalog.QUERIES["stratified_subsample_3000"], catalog.ORACLE["stratified_subsample_3000"])
    assert catalog.stratified_subsample_3000(spark, folder).count() == 3000


def test_queries_without_sql_run(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TIMED", 7)
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"align_topk", "recall_encoded", "experiment_summary"}
    rows = catalog.align_topk(spark, FOLDER).collect()
    assert rows and all(r["qid"] % 50 == 0 and r["qid"] != r["did"] for r in rows)
    assert all(0 <= r["recall"] <= 1 and r["n"] > 0 for r in catalog.recall_encoded(spark, FOLDER).collect())
    rows = catalog.experiment_summary(spark, FOLDER).collect()
    assert len(rows) == 5 and all(float(r["median_ms"]) > 0 for r in rows)


def test_entry_and_optional_part(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    monkeypatch.setitem(sys.modules, "kinfold.llm", None)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from kinfold.session import local_session
print('ROWS', e.queries()['minhash_sig'](local_session('2', 2), {FOLDER!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
