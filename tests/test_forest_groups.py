"""A forest on a large input grows a few trees at a time, on no more columns
than the fit reads, and what is done with leaves the disk."""

import weakref
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vitrine import session
from vitrine.operators import ml, models
from vitrine.operators.explain import predict_tree, tree_arrays


@pytest.fixture
def grown(monkeypatch):
    """The number of trees of each call of Spark's fit."""
    sizes, fit = [], RandomForestClassifier._fit

    def counted(self, data):
        sizes.append(self.getNumTrees())
        return fit(self, data)

    monkeypatch.setattr(RandomForestClassifier, "_fit", counted)
    return sizes


def _rows(spark):
    df = spark.range(0, 400, 1, 2).select("id", *[F.rand(i).alias(c) for i, c in enumerate("abc")])
    df = df.withColumn("y", (F.col("a") + F.col("b") > 1).cast("int"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(models.checkpoint(df))


def _forest(trees):
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=3, seed=7, featureSubsetStrategy="sqrt")


def test_groups_of_trees_are_one_forest(spark, monkeypatch, grown, tmp_path):
    monkeypatch.setattr(models, "SPREAD_FROM", 100)
    monkeypatch.setattr(models, "FOREST_TREES", 4)
    df = _rows(spark)
    forest = models.grow_forest(_forest(10), df)
    assert grown == [4, 4, 2]
    assert forest.getNumTrees == 10 and forest.getOrDefault("numTrees") == 10 and forest.getLabelCol() == "y"
    trees, weights, how = tree_arrays(spark, forest)
    assert len(trees) == 10 and how == "mean" and len({str(t) for t in trees}) == 10
    got = [(r["a"], r["b"], r["c"], r["probability"][1]) for r in forest.transform(df).collect()]
    for *x, p in got[:50]:
        assert p == pytest.approx(np.mean([predict_tree(np.array(x), t) for t in trees]), abs=1e-12)
    forest.write().save(str(tmp_path / "forest"))
    again = type(forest).load(str(tmp_path / "forest"))
    assert [r["probability"][1] for r in again.transform(df).collect()] == [p for *_, p in got]


def test_a_small_input_grows_one_forest_at_once(spark, monkeypatch, grown):
    monkeypatch.setattr(models, "FOREST_TREES", 4)
    df = _rows(spark)
    forest = models.grow_forest(_forest(10), df)
    assert grown == [10]
    splits = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]  # noqa: E731  (the first line has an id)
    assert splits(forest) == splits(_forest(10).fit(df))


def test_the_forests_of_the_workload_grow_in_groups(tables_small, monkeypatch, grown):
    monkeypatch.setattr(models, "SPREAD_FROM", 100)
    monkeypatch.setattr(models, "FOREST_TREES", 3)
    monkeypatch.setitem(models.DELAY_PARAMS, "num_trees", 7)
    monkeypatch.setitem(models.CHURN_MODELS, "random_forest", dict(num_trees=5, max_depth=2))
    t = replace(tables_small, dataset_id=None)
    delay = models._fit_delay(t)[0].stages[-1]
    assert grown == [3, 3, 1] and delay.getNumTrees == 7
    churn = models._fit_churn(t, "random_forest")[0].stages[-1]
    assert grown[3:] == [3, 2] and churn.getNumTrees == 5


def test_a_fit_stores_the_columns_it_reads(tables_small):
    t = replace(tables_small, dataset_id=None)
    assert set(models.churn_data(t).columns) == {"customer_unique_id", "churned", "split", "weight", "pos_weight", *ml.CHURN_FEATURES}
    assert set(models.clv_data(t).columns) == {"customer_unique_id", "future_spend", "split", *ml.CLV_FEATURES}
    assert set(models.delay_data(t).columns) == {"order_id", "is_delayed", "split", "weight", *ml.DELAY_FEATURES}


def test_what_is_done_with_is_released():
    """Asked of the JVM after Python's own references went."""
    class Held:
        pass

    held = Held()
    held.itself = held  # only the collector frees it
    seen, gone = weakref.ref(held), []
    del held

    class Jvm:
        class System:
            @staticmethod
            def gc():
                gone.append(seen() is None)

    class Session:
        class sparkContext:
            _jvm = Jvm

    session.release(Session)
    assert gone and all(gone)
