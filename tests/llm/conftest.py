import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, H long"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents with columns that clash with names the operators use."""
    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1.5, "x", 7) for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def prose():
    """Words of invented text: ``prose(seed, n)``."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        parts = "ka lo mi ne ru sa ti vo zu be da fe go hi ju py".split()
        return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return make
