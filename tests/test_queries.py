import os

import pytest

from lexmill.plans.catalogue import ORACLE, QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(df, ORACLE[name], SF) == []
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_coverage_names_queries_that_exist():
    from lexmill.plans.coverage import by_id

    assert {q for names in by_id().values() for q in names} <= set(QUERIES)
