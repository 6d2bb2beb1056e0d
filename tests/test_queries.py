"""Every query of the library that SQL can say, held against DuckDB; the others run."""

import pytest
from conftest import SF, same_as_sql

from groveline.plans import registry

Q, O = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_sql(spark, duck, name):
    same_as_sql(spark, duck, Q[name], O[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "node_id", "score"]
    assert set(O) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
