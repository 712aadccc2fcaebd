"""Registered queries on the smallest tables against DuckDB, where SQL can state them."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import compare, connect  # noqa: E402

OPERATORS = [n for n in queries() if re.match(r"op\d+_", n)]
NAMES = [n for n in OPERATORS if n in oracle_sql()]
#: queries marked native: nothing of them runs in Python
NATIVE = ("op1_", "op3_")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small, name):
    assert compare(spark, connect(small), small, name, queries()[name], oracle_sql()[name]) is None


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in OPERATORS}
    assert "pipeline" in queries()


@pytest.mark.parametrize("name", OPERATORS)
def test_plans(spark, small, name):
    plan = queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.startswith(NATIVE):
        assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_planted_items_are_found_and_nothing_else(spark, small):
    """Items stand word for word in the documents of these tables."""
    pairs = duckdb.sql(
        f"SELECT doc_id, item_id FROM '{small}/documents.parquet' d JOIN '{small}/benchmark.parquet' b ON contains(d.text, b.text)"
    ).fetchall()
    assert {tuple(r)[:2] for r in queries()["op1_decontamination"](spark, small).collect()} == set(pairs)
