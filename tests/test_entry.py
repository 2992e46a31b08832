import __spark_entry__ as entry


def test_every_query_is_listed_once_and_nearly_all_have_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(queries) - set(sql) <= {"b8_weight_search", *(q for q in queries if q.startswith("op") or q == "pipeline")}


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert {"cusip", "n_funds", "votes"} <= set(df.columns) and df.count() > 0
