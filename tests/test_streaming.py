"""The delay scoring stream over new order files (trigger availableNow)."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vitrine.operators.ml import DELAY_FEATURES, delay_table
from vitrine.streaming.scoring import score_orders, start_delay_scoring, vocabularies


def test_scoring_stream_scores_each_new_order_once(spark, tables_small, tmp_path):
    t = tables_small
    train = delay_table(t)
    model = Pipeline(stages=[VectorAssembler(inputCols=DELAY_FEATURES, outputCol="features"),
                             RandomForestClassifier(labelCol="is_delayed", numTrees=5, maxDepth=3, seed=1)]).fit(train)
    vocab = vocabularies(train)
    src, sink, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    new = t.orders.where(F.col("order_id") % 7 == 0)
    new.where(F.col("order_id") % 2 == 0).write.parquet(src + "/day1")
    q = start_delay_scoring(spark, src + "/*", sink, ckpt, t, model, vocab)
    q.awaitTermination(300)
    first = spark.read.parquet(sink).count()
    # the next day's file: only the new orders are scored
    new.where(F.col("order_id") % 2 == 1).write.parquet(src + "/day2")
    q = start_delay_scoring(spark, src + "/*", sink, ckpt, t, model, vocab)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    expected = score_orders(new, t, model, vocab).count()
    assert first > 0
    assert out.count() == expected
    assert out.select("order_id").distinct().count() == expected
    assert out.where("delay_probability < 0 or delay_probability > 1").count() == 0


def test_every_order_comes_back_even_with_an_unseen_category(spark, tables_small):
    t = tables_small
    train = delay_table(t)
    model = Pipeline(stages=[VectorAssembler(inputCols=DELAY_FEATURES, outputCol="features"),
                             RandomForestClassifier(labelCol="is_delayed", numTrees=3, maxDepth=3, seed=1)]).fit(train)
    vocab = vocabularies(train)
    vocab["customer_state"] = vocab["customer_state"].limit(1)
    out = score_orders(t.orders, t, model, vocab)
    assert out.count() == t.orders.count()
    assert out.where("delay_probability is null and reason is null").count() == 0
    assert out.where("reason like '%state_enc%'").count() > 0
