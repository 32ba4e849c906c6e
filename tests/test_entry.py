import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from sedgeline.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_queries_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    files = [p for p in (ROOT / "sedgeline").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if "sedgeline.llm" in p.read_text() or "from sedgeline import llm" in p.read_text()]


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
    assert "p2_found" in entry.oracle_sql()


def comparable(row):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return repr(tuple(plain(v) for v in row))


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, oracle, name):
    """Every query of the core runs on whole tables, and gives what its SQL does."""
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(comparable(r) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(comparable(r) for r in oracle.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
