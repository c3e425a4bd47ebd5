"""Every market query against its SQL on the small tables; contract of the driver's entry points."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

import pytest
from compare import assert_same

from tidebook.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, sql, name):
    assert_same(QUERIES[name](spark, small), sql, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["symbol", "d", "top", "bottom"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_nothing_imports_the_training_data_operators():
    for path in (ROOT / "tidebook").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "tidebook").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tidebook.llm") or n == "corpus_pipeline" for n in names), path


def test_entry_without_the_training_data_operators():
    """With the folders gone, the other queries are all there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidebook.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
names = set(E.queries())
assert len(names) > 100 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(E.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
