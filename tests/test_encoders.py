"""Dictionary joins, the join-free dataset summary, dense histograms."""

from dataclasses import replace

from pyspark.sql import functions as F

from vitrine.operators.audit import dataset_summary
from vitrine.operators.ml import label_codes
from vitrine.operators.profit import equal_width_histogram


def test_codes_are_the_same_broadcast_or_salted(spark):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 3 else f"v{i % 40:02d}") for i in range(2000)], "id long, c string")
    small = label_codes(df, "c", "none", "code")
    large = label_codes(df, "c", "none", "code", dictionary=5)
    assert sorted(map(tuple, small.select("id", "c", "code").collect())) == sorted(map(tuple, large.select("id", "c", "code").collect()))
    names = sorted({r["c"] for r in small.select("c").collect()})
    assert {(r["c"], r["code"]) for r in small.collect()} == {(c, i) for i, c in enumerate(names)}
    # the rows of the small one are not moved; those of a hot value in the large one go to several tasks
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = large.where("c = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1
    assert label_codes(df.limit(0), "c", "none", "code").count() == 0


def test_summary_without_a_join_equals_the_join(spark, tables_small):
    t = tables_small
    orders = t.orders.limit(50).unionByName(t.orders.limit(3).withColumn("order_id", -1 - F.col("order_id")).withColumn("customer_id", F.lit(None).cast(t.orders.schema["customer_id"].dataType))).checkpoint()
    pays = t.payments.unionByName(t.payments.limit(5).withColumn("order_id", F.lit(10**9).cast(t.payments.schema["order_id"].dataType)))
    people = t.customers.unionByName(t.customers.limit(4))  # a customer listed twice
    odd = replace(t, orders=orders, payments=pays, customers=people)
    wide = orders.join(pays, "order_id", "left").join(people, "customer_id", "left")
    want = wide.agg(F.count(F.lit(1)), F.count_distinct("customer_unique_id"), F.count_distinct("order_id")).first()
    got = dataset_summary(odd)
    assert tuple(got.select("n_rows", "unique_customers", "unique_orders").first()) == tuple(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    none = dataset_summary(replace(t, orders=orders.limit(0), payments=pays, customers=people)).first()
    assert none["n_rows"] == 0 and none["unique_orders"] == 0


def test_histograms_list_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 9.9), ("b", 5.0), ("b", None), ("c", None)], "g string, x double")
    rows = equal_width_histogram(df, F.col("x"), 10, ["g"]).collect()
    assert sorted((r["g"], r["bin"], r["n"]) for r in rows) == [("a", i, {0: 1, 9: 2}.get(i, 0)) for i in range(10)] + [("b", i, 1 if i == 0 else 0) for i in range(10)]
    assert equal_width_histogram(df, F.col("x"), 4).agg(F.sum("n")).first()[0] == 4
    assert equal_width_histogram(df.limit(0), F.col("x"), 4).count() == 0
