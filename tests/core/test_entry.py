import __spark_entry__ as entry


def test_every_sql_has_its_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["ref_table", "month", "kind", "cause", "orphans"] and df.count() > 0
