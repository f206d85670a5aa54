"""The driver's contract."""

import __spark_entry__ as entry


def test_names_agree():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "vec_id", "distance"] and df.count() == 100
