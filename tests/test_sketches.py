"""Sketches: merged equals made at once, errors hold, nulls and empty groups."""

from pyspark.sql import functions as F

from vitrine.plans.sketches import distinct_estimate, hll_error, kll_error, merge, quantile_estimate, sketch


def test_merged_months_stay_within_the_stated_error(spark):
    # a third of all rows carries one value
    df = spark.range(60000).select(
        (F.col("id") % 7).alias("month"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20011).alias("who"),
        ((F.col("id") * 7919) % 60000).cast("double").alias("x"))
    per_month = sketch(df, ["month"], distinct=["who"], quantiles=["x"])
    got = merge(per_month).select(
        "rows", distinct_estimate("hll_who").alias("who"),
        *[quantile_estimate("kll_x", p).alias(f"q{int(p * 100)}") for p in (0.01, 0.5, 0.99)]).first()
    exact = df.select("who").distinct().count()
    assert got.rows == 60000
    assert abs(got.who - exact) <= 4 * hll_error() * exact
    for p, q in ((0.01, got.q1), (0.5, got.q50), (0.99, got.q99)):
        assert abs(q / 60000 - p) <= 4 * kll_error() + 1 / 60000


def test_nulls_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, None), ("b", None, None)], "g string, k string, v double")
    s = sketch(df, ["g"], distinct=["k"], quantiles=["v"])
    got = {r.g: r for r in s.select("g", "rows", distinct_estimate("hll_k").alias("n"), quantile_estimate("kll_v", 0.5).alias("m")).collect()}
    assert (got["a"].rows, got["a"].n, got["a"].m) == (2, 1, 1.0)
    assert (got["b"].rows, got["b"].n, got["b"].m) == (1, 0, None)
    all_ = merge(s).select("rows", distinct_estimate("hll_k").alias("n"), quantile_estimate("kll_v", 0.5).alias("m")).first()
    assert tuple(all_) == (3, 1, 1.0)
    assert merge(s.where("g = 'none'"), ["g"]).count() == 0
