import pytest
from oracle import connect, same

from kinfold.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    same(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLE[name])


def test_every_protein_has_one_split(spark):
    got = queries.p1_splits(spark, FOLDER).collect()
    assert len(got) == len({r["pid"] for r in got})
    assert len({r["component"] for r in got}) == len({(r["component"], r["split"]) for r in got})


def test_containers(spark):
    parts = queries.p6_containers(spark, FOLDER).collect()
    fill = {}
    for r in parts:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert max(fill.values()) <= 1024
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").distinct().count()
    assert len({r["doc_id"] for r in parts}) == whole


def test_library_does_not_import_the_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "kinfold.llm" not in p.read_text(), p
