"""Every registered query against its SQL on DuckDB, over the smallest test tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from compare import check, oracle

from plumbline.queries import all_queries

QUERIES = all_queries()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    rows, problem = check(spark, con, QUERIES[name], small)
    assert problem is None
    assert rows >= 0


def test_queries_without_the_corpus_folders(tmp_path):
    """A copy without the corpus operators imports and registers all other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    told = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    got = subprocess.run([sys.executable, "-c", told], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert got.stdout.split() == [str(len(all_queries())), "True", "False"], got.stderr
