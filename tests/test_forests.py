"""Forests are fitted and score in sessions where something was observed."""

from dataclasses import replace

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F
from suite import SF_SMALL

from vitrine.operators import ml, models
from vitrine.sources.tables import RetailTables


@pytest.fixture
def apart(spark):
    """Tables of a session of their own: what is observed there stays there."""
    return replace(RetailTables.from_tpch(spark.newSession(), SF_SMALL, materialize=False), dataset_id=None)


def test_a_forest_scores_after_the_class_balance(apart):
    ml.delay_class_balance(apart).collect()
    rows = ml.delay_table(apart)
    forest = RandomForestClassifier(labelCol="is_delayed", numTrees=2, maxDepth=2, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=ml.DELAY_FEATURES, outputCol="features"), forest]).fit(rows)
    assert len(model.transform(rows).select("probability").collect()) == rows.count()


def test_the_fits_score_in_an_observed_session(apart, monkeypatch):
    monkeypatch.setitem(models.DELAY_PARAMS, "num_trees", 2)
    monkeypatch.setitem(models.CHURN_MODELS, "random_forest", dict(num_trees=2, max_depth=2))
    apart.orders.observe(Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    assert models._fit_churn(apart, "random_forest")[1].count() > 0
    assert models._fit_delay(apart)[1].count() > 0
