from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    """Python workers find the package wherever pytest was started."""
    before = os.environ.get("PYTHONPATH", "")
    spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{before}"


@pytest.fixture
def docs(spark):
    """documents-like frame from (doc_id, text[, lang[, source]]) rows, with columns whose names might clash."""

    def build(rows):
        full = [tuple(r) + (None,) * (4 - len(r)) + (i, "x", i) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_lines int, _kept string, score int"
        )

    return build
