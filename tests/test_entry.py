import __spark_entry__
from chalkstream.plans import registry


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and len(df.columns) == 58


def test_every_sql_has_a_query():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(registry.queries()) <= set(known)
