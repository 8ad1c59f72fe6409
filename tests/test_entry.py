"""The driver's contract, and every general query against its SQL."""

import os
import subprocess
import sys

import differential
import pytest

import __spark_entry__
from archivolt.plans import archive_queries, corpus_queries

GENERAL = {**archive_queries.SQL, **corpus_queries.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(differential.FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return differential.database()


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert __spark_entry__.entry(spark).columns == ["table_name", "key_text"]


def test_library_stands_without_the_text_subpackage():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("archivolt.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "p2_found" in e.queries() and "p1_found" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
import bench
"""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={**os.environ, "PYTHONPATH": root})


@pytest.mark.parametrize("name", sorted(GENERAL))
def test_query_equals_sql(spark, con, name):
    differential.compare(spark, __spark_entry__.queries()[name], GENERAL[name], con)
