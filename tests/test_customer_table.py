"""The stored customer table lies in tasks of a sensible size."""

from vitrine.operators import ml


def test_customers_are_not_cut_into_tiny_tasks_by_a_cross_join(tables_small, monkeypatch):
    stored = []
    monkeypatch.setattr(ml, "checkpoint", lambda df: stored.append(df) or df)
    monkeypatch.setattr(ml, "grouped_quantiles", lambda *a: a[0].sparkSession.sql("SELECT 3.0D AS q"))
    assert ml.customer_table(tables_small).where("recency_days is null").count() == 0
    assert "NestedLoop" not in stored[0]._jdf.queryExecution().executedPlan().toString()
