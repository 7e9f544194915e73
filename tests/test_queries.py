"""Every radar query against its SQL; those without SQL must run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import SMALL, compare  # noqa: E402

from echofield.plans import cube_queries, format_queries, track_queries, volume_queries

MODULES = [cube_queries, track_queries, volume_queries, format_queries]
CASES = [(name, f, m.SQL.get(name)) for m in MODULES for name, f in m.QUERIES.items()]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, query, sql):
    if sql is None:
        assert query(spark, SMALL).count() > 0
    else:
        compare(spark, query, sql)


def test_names_are_unique():
    assert len({c[0] for c in CASES}) == len(CASES)
