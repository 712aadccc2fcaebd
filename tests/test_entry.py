"""What the entry module registers when parts of the repository or their packages are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from shapewright.plans.all_queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["shapewright.llm", "corpus_pipeline", "ahocorasick", "numpy"])
def test_the_other_queries_stay(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
print(*e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    known = set(done.stdout.split())
    assert set(QUERIES) <= known and "pipeline" not in known
