"""Every query of the library against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

from gaugewell.plans import catalogs
from tests.oracle import connect, same

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: (f, catalog.oracles.get(name)) for catalog in catalogs() for name, f in catalog.queries.items()}
#: Too few responses per item at this size for their threshold.
LARGER = {"j5_analysis_frame", "t6_review_budget_topk"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    function, sql = QUERIES[name]
    frame = function(spark, SF_DIR)
    if sql is None:
        assert frame.columns and len(set(frame.columns)) == len(frame.columns)
        frame.collect()
    else:
        same(frame, duck.sql(sql))


def test_names_are_unique():
    names = [name for catalog in catalogs() for name in catalog.queries]
    assert len(names) == len(set(names))
