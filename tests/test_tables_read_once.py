"""Queries that read described blocks twice read them from a table: the text of a plan is worked through once."""

import pytest

from strataloom.plans import levels as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["level_window_classify", "common_measures"])
def test_documents_are_not_read_again(spark, name):
    files = list(getattr(P, name)(spark, SF).inputFiles())
    assert files and not any("documents.parquet" in f for f in files)
