import __spark_entry__ as driver


def test_flagship_query(spark):
    result = driver.entry(spark)
    assert result.columns == ["day", "region", "revenue", "order_count"]
    assert result.count() > 0


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) >= 60
