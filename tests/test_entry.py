import __spark_entry__ as E


def test_entry_and_names(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "grep_lines_by_lang" in E.queries()
