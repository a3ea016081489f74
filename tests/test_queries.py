import pytest
from conftest import DATA, rows

from plumbline.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    mine = rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        assert mine == rows([c[0] for c in found.description], found.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
