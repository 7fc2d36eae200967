"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.verify import compare, connect

ROOT = "/root/testdata/sf0.001"
CORE = [k for m in entry._MODULES for k in m.QUERIES]


@pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    said = compare(spark, connect(ROOT), name, entry.queries()[name], entry.oracle_sql().get(name), ROOT)
    assert said.startswith(("ok", "rows")), said


def test_core_does_not_import_llm():
    for p in Path(entry.__file__).parent.glob("citeloom/**/*.py"):
        if "llm" not in p.parts:
            assert "citeloom.llm" not in p.read_text()
