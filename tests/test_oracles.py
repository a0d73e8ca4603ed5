"""Every query outside the llm subpackage against its SQL on the smallest data; those without SQL give rows."""

import pytest
from conftest import rows

from tidemark.plans import pipelines, queries
from tidemark.streaming import drift

QUERIES = queries.QUERIES | drift.QUERIES
ORACLES = queries.ORACLES | drift.ORACLES
assert pipelines.PIPELINES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    got = QUERIES[name](spark, data).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
