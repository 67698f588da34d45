"""Every registered query against its SQL counterpart, on the smallest generated tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registered

duckdb = pytest.importorskip("duckdb")
TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="generated tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def in_name_order(names, rows):
    places = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


def test_every_query_has_a_counterpart():
    assert registered.core_queries().keys() == registered.core_oracle_sql().keys()


@pytest.mark.parametrize("name", registered.core_queries())
def test_query(spark, database, name):
    found = registered.core_queries()[name](spark, str(TABLES))
    expected = database.execute(registered.core_oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert in_name_order(found.columns, found.collect()) == in_name_order(names, expected.fetchall())


def test_flagship(spark):
    assert registered.entry(spark).columns == ["bucket_start", "group_value", "count"]


_HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if any(name == hidden or name.startswith(hidden + ".") for hidden in sys.argv[1:]):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Hide())
import __spark_entry__ as registered
assert registered.queries().keys() >= registered.core_queries().keys()
assert registered.oracle_sql().keys() >= registered.core_oracle_sql().keys()
print(len(registered.queries()) == len(registered.core_queries()))
"""


@pytest.mark.parametrize("hidden", [["emberlog.llm"], ["emberlog.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_without_optional_parts(hidden):
    """The subpackage, the pipeline or both may be gone; everything else is still registered."""
    root = Path(registered.__file__).parent
    run = subprocess.run([sys.executable, "-c", _HIDDEN, *hidden], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == str("emberlog.llm" in hidden or not (root / "emberlog/llm").exists())
