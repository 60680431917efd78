import __spark_entry__ as entry


def test_registry_and_sql_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
