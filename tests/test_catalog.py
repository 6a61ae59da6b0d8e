"""Every registered query of the library proper against its SQL on the smallest tables."""

import pytest

from tests.conftest import rows
from trellis.plans import registry

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b or all(x == pytest.approx(y, abs=1e-4) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
