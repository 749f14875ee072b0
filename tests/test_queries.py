"""Every query with SQL gives DuckDB's rows; the contract functions hold together."""

import pytest
from conftest import SMALL, same_rows

import __spark_entry__ as entry
from ingestlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


def test_works_without_llm():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('ingestlens.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'sta1_account_statistics' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
