import pytest

from chronoloom.plans import catalog as queries
from tests.parity import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["app", "total_us", "n_entries", "first_ord"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
