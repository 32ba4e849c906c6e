import os

import pytest

from sedgeline.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    """Every query runs on whole tables, and gives what its SQL does."""
    if name == "p6_ids" and not os.path.isdir("/opt/tokenizers"):
        pytest.skip("no vocabulary file")
    duckdb = pytest.importorskip("duckdb")
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        assert rows == sorted(repr(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert spark.catalog.listTables() == []
