"""What the fits read lies in even tasks, and the fits of one query run side by side."""

import threading
from dataclasses import replace

from pyspark.sql import functions as F

from vitrine.operators import explain, models


def _train_rows(df):
    """Train rows of each of the tasks, those without any included."""
    train = (df["split"] == "train").cast("int")
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(train).alias("n")).collect()]


def _ranked(spark, n):
    """The first fifth of the rows, as they lie, is all test rows."""
    return spark.range(0, n, 1, 4).select("id", F.when(F.col("id") < n // 5, "test").otherwise("train").alias("split"))


def test_a_large_input_is_spread_evenly(spark, monkeypatch):
    df = _ranked(spark, 8000)
    assert models.spread(df, "id").rdd.getNumPartitions() == 4  # a small one stays
    monkeypatch.setattr(models, "SPREAD_FROM", 100)
    even = models.spread(df, "id")
    rows = _train_rows(even)
    assert len(rows) == spark.sparkContext.defaultParallelism and max(rows) < 1.3 * min(rows)
    assert sorted(even.collect()) == sorted(df.collect())


def test_a_task_of_a_fit_holds_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "SPREAD_FROM", 100)
    monkeypatch.setattr(models, "TASK_ROWS", 200)
    assert models.spread(_ranked(spark, 8000), "id").rdd.getNumPartitions() == 40


def test_the_inputs_of_all_fits_are_spread(tables_small, monkeypatch):
    t = replace(tables_small, dataset_id=None)
    monkeypatch.setattr(models, "SPREAD_FROM", 0)
    for data in (models.churn_data(t), models.clv_data(t), models.delay_data(t)):
        rows = _train_rows(data)
        assert len(rows) == 8 and max(rows) < 2 * min(rows)


def test_the_fits_of_a_query_run_side_by_side(tables_small, monkeypatch):
    t = replace(tables_small, dataset_id=None)
    meet, done = threading.Barrier(4, timeout=60), []

    def fit(tables, name="delay"):
        meet.wait()  # broken unless all four are under way
        done.append(name)

    monkeypatch.setattr(models, "fit_churn", fit)
    monkeypatch.setattr(models, "fit_delay", fit)
    models.fit_together(t, *models.CHURN_MODELS, "delay")
    assert sorted(done) == sorted([*models.CHURN_MODELS, "delay"])


def test_queries_on_several_models_fit_them_together(tables_small, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def together(t, *names):
        asked.append(names)
        raise Asked

    monkeypatch.setattr(models, "fit_together", together)
    t = replace(tables_small, dataset_id=None)
    for query in (models.model_comparison, models.roc_curve, models.auc_rank, models.score_risk_flags,
                  models.feature_importance, explain.explain_rows):
        try:
            query(t)
        except Asked:
            pass
    churn = tuple(models.CHURN_MODELS)
    assert asked == [churn, churn, (*churn, "delay"), (*churn, "delay"), (*churn, "clv", "delay"), (*churn, "delay")]
