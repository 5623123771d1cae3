"""Every SQL-expressible registered query against its DuckDB twin (the driver's gate)."""

import pytest

from oracle import compare, duck
from punctual.plans.registry import load_all

REG = load_all()
SQL_QUERIES = sorted(n for n, q in REG.items() if q.sql)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, sf, con, name):
    q = REG[name]
    r = compare(q.build(spark, sf), con, q.sql)
    assert r["schema_match"], r
    assert r["rows_match"], r
    assert r["values_match"], r.get("first_diffs")


def test_registry_covers_inventory():
    ids = {i for q in REG.values() for i in q.ids}
    expected = {f"P{i}" for i in range(1, 15)} | {f"X{i}" for i in range(1, 22)} | \
        {f"A{i}" for i in range(1, 13)} | {"J1", "J2", "J3", "J4", "J5", "J6", "J7"} | \
        {"W1", "W2", "W3", "W4", "K1", "K2", "K3", "K4", "K5", "K6", "U1"} | {f"D{i}" for i in range(1, 9)} | \
        {f"V{i}" for i in range(1, 8)} | {f"M{i}" for i in range(1, 20)} | \
        {"IO1", "IO2", "IO3", "IO4", "IO5", "IO6", "IO7", "IO8", "IO9"}
    assert expected - ids == set()
