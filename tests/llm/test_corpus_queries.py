"""Corpus queries against their SQL, over the smallest tables."""

from __future__ import annotations

import pytest
from compare import check, oracle

from plumbline.llm.queries import all_queries

QUERIES = all_queries()


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query(spark, small, name):
    rows, problem = check(spark, oracle(small), QUERIES[name], small)
    assert problem is None
    assert rows > 0
