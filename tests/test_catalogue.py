"""Every registered query against its SQL, and that it runs without."""

import pytest

from sedimenta.plans.catalogue import FLAGSHIP, QUERIES, SQL
from tests.compare import compare


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert compare(spark, data, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def _far_documents(spark, folder, *texts):
    """Documents of one source whose ids no int holds, the last text under the smallest."""
    rows = [(2**40 - k, "a.md", text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source_path string, text string").write.parquet(f"{folder}/documents.parquet")


def test_numbering_of_ids_beyond_int(spark, tmp_path):
    _far_documents(spark, tmp_path, "x\ny", None, "z\n\nz")
    got = sorted((r["chunk_index"], r["section_index"], r["chunk_in_section"]) for r in QUERIES["chunk_numbering"](spark, str(tmp_path)).collect())
    assert got == [(0, 2**40 - 2, 0), (1, 2**40 - 2, 1), (2, 2**40 - 2, 2), (3, 2**40, 0), (4, 2**40, 1)]


def test_batches_of_ids_beyond_int(spark, tmp_path):
    _far_documents(spark, tmp_path, "\n" * 69, "\n" * 59)
    got = QUERIES["embed_batches"](spark, str(tmp_path)).collect()
    assert sorted((r["source_path"], r["batch_no"], r["n_chunks"]) for r in got) == [("a.md", 0, 64), ("a.md", 1, 64), ("a.md", 2, 2)]
