"""Every query with an SQL counterpart, on the smallest tables, against DuckDB."""

import glob
import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not supplied")

from catalog.oracle import ORACLE_SQL      # noqa: E402
from catalog.queries import QUERIES        # noqa: E402


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    wanted = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[c] for c in columns) for r in df.collect()) == order(wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_entry_stands_without_the_second_part():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # a module that is None fails to import, as one does that lacks something it needs
    code = (f"import sys; sys.path.insert(0, {here!r}); sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), 'op1_html_text' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "False"]
