import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0
