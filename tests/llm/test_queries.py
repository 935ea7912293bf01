import pytest

from sedimenta.llm.catalogue import QUERIES, SQL
from tests.compare import compare

COLUMNS = {"p1_found": ["vec_id_a", "vec_id_b"], "p2_found": ["rec_table", "rec_id", "markup"], "p5_found": ["page_id", "ref_code"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        assert compare(spark, data, name, QUERIES[name], SQL[name]) == ""
        return
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))
