import __spark_entry__ as entry


def test_catalogue_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 50 and set(oracles) <= set(queries)
