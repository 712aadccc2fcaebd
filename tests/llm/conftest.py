import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    return [a + b for a in ("ta", "re", "mo", "li", "su", "ke", "no", "vi") for b in ("n", "r", "st", "l", "m", "", "ck", "d")]


@pytest.fixture(scope="session")
def prose(words):
    """A function from a seed and a length to a text."""
    return lambda seed, n: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use."""
    long = prose(1, 30_000)
    texts = [None, "", " \t\n", "one", "one two", prose(2, 80), prose(2, 80), long, long + " end", "ünï ©öde 𝔘𝔫𝔦 " * 30, None, "x" * 50_000, "7" * 20_000]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(3, 60), None, None, None), (None, None, None, None, None)]
    more = "size long, key long, row long, label string, score double, region long, total long, hits string, `order` string"
    wide = [r + (1, 2, 3, "x", 0.5, 4, 5, "h", "o") for r in rows]
    return spark.createDataFrame(wide, f"{SCHEMA}, {more}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i is not None else None, len(t or "")) for i, t in rows], SCHEMA)

    return build
