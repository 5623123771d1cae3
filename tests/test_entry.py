import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["traffic_condition", "is_rush_hour", "n_trips", "late_rate", "weekend_trips"]


def test_contract_keys():
    q, s = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
