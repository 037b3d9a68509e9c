"""Every query of the reference's operators against its SQL, and the folders that may be absent."""

import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    d = registry.queries()[name](spark, SF)
    columns = sorted(d.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == columns
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in d.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_entry_without_the_training_data_folder(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('millrace.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
