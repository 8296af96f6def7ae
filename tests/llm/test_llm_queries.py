"""The pN queries against their SQL, or for rows and schema without one."""

import pytest

from siltweave.llm.queries import QUERIES
from siltweave.llm.sql import SQL
from tests.compare import assert_same

COLUMNS = {"p1_found": "src rec_id", "p2_found": "src rec_id kind elem", "p3_found": "src id_a id_b", "p4_found": "result_id line_no", "p5_found": "src cache_id block", "p7_found": "doc_id item_id", "p8_found": "doc_id level"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    if name in SQL:
        assert_same(df, SQL[name], data)
    else:
        assert df.count() >= 0
