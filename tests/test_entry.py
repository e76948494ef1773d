import __spark_entry__ as entry
from probity import queries as core


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.ORACLE) <= set(core.QUERIES)
