import __spark_entry__ as entry
from melisma.plans import catalogue


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_its_query():
    assert set(catalogue.twins()) <= set(catalogue.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
