"""Percentiles put together from single deliveries, by month and size group."""

from paneloom.llm import panel
from paneloom.operators.history import latest_delivery
from paneloom.sources import table


def test_deliveries_have_every_size_group(spark, tiny):
    merged = panel.p1_deliveries(spark, tiny).collect()
    final = latest_delivery(table(spark, tiny, "chars_final_with_names", ["permno", "eom", "delivery_id", "size_grp", "me", "ret"]), ["permno", "eom"], "delivery_id", ["size_grp", "me", "ret"])
    values = {}
    for r in panel.usable_measures(final).collect():
        values.setdefault((r.measure, str(r.eom)[:10], r.size_grp), []).append(r.x)
    assert {(r.measure, r.eom, r.size_grp, r.prob) for r in merged} == {(*k, p) for k in values for p in panel.PROBS}
    for r in merged:
        v = values[r.measure, r.eom, r.size_grp]
        assert r.n == len(v)
        place = int((r.n - 1) * r.prob + 1e-9) + 1
        low, high = sum(x < r.percentile for x in v), sum(x <= r.percentile for x in v)
        assert low + 1 - r.rank_error <= place <= high + r.rank_error
