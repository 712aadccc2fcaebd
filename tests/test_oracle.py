"""Every query that SQL can state, against an independent engine on the same files."""

import sys
from pathlib import Path

import pytest

from shapewright.plans.all_queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, small, con, name):
    problem = compare(spark, con, small, name, QUERIES[name], ORACLES.get(name))
    assert problem in (None, "equal, but no rows")
