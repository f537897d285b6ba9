"""Results that a query reads more than once are computed once."""

import pytest

from pgsloom.queries import QUERIES
from pgsloom.sources.store import ResultStore


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("l_discount")


@pytest.mark.parametrize("name", ["results_summary", "other_scores"])
def test_stored_before_the_join(spark, sf_dir, name):
    assert scans(QUERIES[name](spark, sf_dir)) == 0


def test_store_merges_stored_rows(spark, sf_dir, monkeypatch):
    merged, merge = [], ResultStore.merge
    monkeypatch.setattr(ResultStore, "merge", lambda self, new: (merged.append(scans(new)), merge(self, new))[1])
    QUERIES["store_merge"](spark, sf_dir)
    assert merged == [0, 0, 0]
