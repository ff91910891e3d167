"""Shared helpers of the operator tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, rid string, copies string"


@pytest.fixture
def docs(spark):
    """A documents table, with extra columns whose names clash with internal ones."""

    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, "h", "r", "c") for r in rows], DOCS).repartition(3)

    return make
