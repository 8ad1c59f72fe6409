"""The registered text-corpus queries on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import differential

from archivolt.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(differential.FOLDER), reason="no test tables here")
COLUMNS = {
    "p1_found": ["first_id", "copy_id"], "p3_found": ["view_id", "line_no"], "p4_found": ["kept_id", "row_id"], "p7_found": ["view_id"], "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    differential.compare(spark, queries.QUERIES[name], queries.SQL[name], differential.database())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, differential.FOLDER)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    assert len(rows) == len({tuple(map(str, r)) for r in rows}) and (rows or name == "p4_near")  # no near copies among so few pages
