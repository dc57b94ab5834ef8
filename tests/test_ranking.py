"""global_rank and friends against single-partition windows / numpy, with the
data forced over many partitions (no AQE coalescing) so offsets matter."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.plans.ranking import (
    global_cumsum,
    global_rank,
    grouped_quantiles,
    ntile,
    qcut_bin,
    quantile_edges,
    rank_sum,
)


@pytest.fixture()
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _frame(spark, n=1003):
    # a hot value held by a third of the rows, plus ties elsewhere
    rows = [(i, 1 if i % 3 == 0 else (i * 7919) % 97, float((i * 31) % 50)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, v double").repartition(7)


def test_global_rank_is_row_number(many_parts):
    df = _frame(many_parts)
    got = global_rank(df, [F.col("k").desc(), F.col("id")], "r")
    ref = df.withColumn("r2", F.row_number().over(Window.orderBy(F.col("k").desc(), "id")))
    bad = got.join(ref, "id").where(F.col("r") != F.col("r2")).count()
    assert bad == 0
    assert got.agg(F.min("r"), F.max("r")).first() == (1, 1003)


@pytest.mark.parametrize("n", [3, 5, 12, 1003])
def test_ntile_matches_window(many_parts, n):
    df = _frame(many_parts, n)
    got = ntile(df, 5, [F.col("k").asc(), F.col("id")], "b")
    ref = df.withColumn("b2", F.ntile(5).over(Window.orderBy("k", "id")))
    assert got.join(ref, "id").where(F.col("b") != F.col("b2")).count() == 0


def test_quantiles_match_numpy(many_parts):
    df = _frame(many_parts)
    probs = [0.2, 0.25, 0.5, 0.75, 0.8]
    edges = quantile_edges(df, "v", probs, ["id"]).first()["edges"]
    vals = np.array([r[0] for r in df.select("v").collect()])
    assert np.allclose(edges, np.quantile(vals, probs))


def test_grouped_quantiles_match_numpy(many_parts):
    df = _frame(many_parts).withColumn("g", (F.col("id") % 3).cast("int"))
    q = grouped_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0], ["g"], ["id"]).collect()
    pdf = df.toPandas()
    for r in q:
        ref = np.quantile(pdf[pdf.g == r["g"]].v.to_numpy(), r["p"])
        assert abs(r["q"] - ref) < 1e-9


def test_qcut_bin_right_closed_with_duplicate_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,)], "x double")
    out = df.select(qcut_bin(F.col("x"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))).alias("b")).collect()
    assert [r.b for r in out] == [0, 0, 2, 2, 3]


def test_rank_sum_average_ranks(many_parts):
    df = _frame(many_parts, 200)
    rs = rank_sum(df, "v", F.col("id") % 2 == 0, ["id"]).first()
    pdf = df.toPandas()
    ranks = pdf.v.rank(method="average")
    assert abs(rs["rank_sum"] - ranks[pdf.id % 2 == 0].sum()) < 1e-9
    assert rs["n1"] + rs["n2"] == 200


def test_global_cumsum(many_parts):
    df = _frame(many_parts, 500)
    got = global_cumsum(df, [F.col("v").desc(), F.col("id")], ["k"]).toPandas()
    pdf = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    pdf["ref"] = pdf.k.cumsum()
    m = got.merge(pdf[["id", "ref"]], on="id")
    assert (m.cum_k == m.ref).all()


def test_no_single_partition_window_over_detail_rows(spark, tables_small):
    from vitrine.operators.rfm import rfm_segments

    plan = rfm_segments(tables_small)._jdf.queryExecution().executedPlan().toString()
    assert "ntile" not in plan.lower()


def test_hot_key_spreads_over_partitions(many_parts):
    """A value held by a third of the rows must not land in one task: the
    range exchange orders on (value, tie-break), so the hot value is split."""
    n = 30000
    df = many_parts.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("k"), "id")
    sorted_parts = df.orderBy("k", "id").select(F.spark_partition_id().alias("p"), "k")
    hot = sorted_parts.where("k = 7").groupBy("p").count().collect()
    assert len(hot) >= 2                       # the hot value spans several tasks
    assert max(r["count"] for r in hot) < n / 3  # and none of them holds it all
    ranked = global_rank(df, [F.col("k"), F.col("id")], "r")
    assert ranked.agg(F.countDistinct("r")).first()[0] == n


def test_item_numbering_with_a_hot_order(many_parts):
    """order_item_id for an order holding a third of all lines is still
    1..n within the order (global rank minus the order's first rank)."""
    from vitrine.sources.tables import tpch_views

    n = 3000
    li = many_parts.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).cast("long").alias("l_orderkey"),
        (F.col("id") % 7).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        F.col("id").cast("int").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"),
        (F.col("id") * 1.5 + 100).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
        F.lit(0.0).alias("l_tax"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("l_shipdate"))
    empty = {k: many_parts.createDataFrame([], s) for k, s in {
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                  "o_orderdate timestamp_ntz, o_orderpriority string",
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"}.items()}
    items = tpch_views({"lineitem": li, **empty})["items"]
    hot = items.where("order_id = 1").agg(F.min("order_item_id"), F.max("order_item_id"),
                                          F.countDistinct("order_item_id")).first()
    assert tuple(hot) == (1, n // 3, n // 3)
