"""Plan shape checks: pruning, pushdown, partial aggregation."""

import io
from contextlib import redirect_stdout

from punctual.plans.registry import load_all

REG = load_all()


def plan(spark, sf, name):
    spark.catalog.clearCache()  # cached frames of other tests would replace the scans
    buf = io.StringIO()
    with redirect_stdout(buf):
        REG[name].build(spark, sf).explain("formatted")
    return buf.getvalue()


def test_flagship_prunes_and_pushes_down(spark, sf):
    p = plan(spark, sf, "late_rate_by_traffic_rush")
    assert "PushedFilters: [IsNotNull(delay_minutes)]" in p
    schema = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")][0]
    assert "trip_key" not in schema and "destination" not in schema
    assert p.index("HashAggregate") < p.index("Exchange")  # final agg above the shuffle, partial below


def test_dedup_combines_before_shuffle(spark, sf):
    p = plan(spark, sf, "dedup_keep_first").split("\n\n\n")[0]
    lines = [ln.strip(" +-:") for ln in p.splitlines()]
    ex = next(i for i, ln in enumerate(lines) if ln.startswith("Exchange"))
    assert any("Aggregate" in ln for ln in lines[ex + 1:])  # partial aggregate under the exchange


def test_curve_uses_bucket_windows_and_broadcast_offsets(spark, sf):
    p = plan(spark, sf, "pr_curve")
    assert "Window" in p and "BroadcastHashJoin" in p
