"""Approximate distinct customers and median order values per month and over
all months, with the sketches' stated errors checked against the exact
answers (AG2, AG15, AG17: the choices for scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import month_label, rnd
from vitrine.plans.ranking import checkpoint
from vitrine.plans.sketches import distinct_estimate, hll_error, kll_error, merge, quantile_estimate, sketch
from vitrine.sources.tables import RetailTables

QUERIES = ("approx_customers_by_month", "approx_median_by_month")

ALL = "all"
# Estimates are held to this many times the stated error.
SIGMAS = 4


def _months(t: RetailTables) -> DataFrame:
    o = t.orders.select("order_id", "customer_id", month_label("order_purchase_timestamp").alias("month"))
    return o.where(F.col("month").isNotNull())


def _with_total(per_month: DataFrame) -> DataFrame:
    """The months' sketches and, merged from them, one row for all."""
    kept = checkpoint(per_month)
    return kept.unionByName(merge(kept).withColumn("month", F.lit(ALL)))


def customer_sketches(t: RetailTables) -> DataFrame:
    """Sketch of the distinct customers of every month, and of all."""
    rows = _months(t).join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
    return _with_total(sketch(rows, ["month"], distinct=["customer_unique_id"]))


def approx_customers_by_month(t: RetailTables) -> DataFrame:
    """AG2, AG15: orders and distinct customers per month and over all, the
    exact count and whether the estimate lies within four standard errors."""
    rows = checkpoint(_months(t).join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
                      .groupBy("month", "customer_unique_id").agg(F.count(F.lit(1)).alias("n")))
    exact = rows.groupBy("month").agg(F.sum("n").alias("orders"), F.count("customer_unique_id").alias("customers"))
    people = rows.groupBy("customer_unique_id").agg(F.sum("n").alias("n"))
    exact = exact.unionByName(people.agg(F.sum("n").alias("orders"), F.count("customer_unique_id").alias("customers"))
                              .withColumn("month", F.lit(ALL)))
    est = customer_sketches(t).select("month", distinct_estimate("hll_customer_unique_id").alias("_e"))
    # rounding: an estimate is a whole number
    off = F.abs(F.col("_e") - F.col("customers")) <= SIGMAS * hll_error() * F.col("customers") + 1
    return exact.join(est, "month").select("month", "orders", "customers", off.alias("within_error"))


def median_sketches(t: RetailTables) -> DataFrame:
    """Sketch of the order values (items and freight) of every month, and of all."""
    return _with_total(sketch(_values(t), ["month"], quantiles=["value"]))


def _values(t: RetailTables) -> DataFrame:
    value = t.items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).cast("double").alias("value"))
    return _months(t).join(value, "order_id").where(F.col("value").isNotNull()).select("month", "value")


def approx_median_by_month(t: RetailTables) -> DataFrame:
    """AG17: orders with items and revenue per month and over all, and whether
    the approximate median's true rank lies within four errors of the middle.
    The rank is counted: rows below and up to the estimate, in one pass."""
    rows = checkpoint(_values(t))
    est = median_sketches(t).select("month", quantile_estimate("kll_value", 0.5).alias("_m"))
    # a row per month: bounded, broadcast
    est = checkpoint(est)
    total = est.where(F.col("month") == ALL).select(F.col("_m").alias("_all"))
    seen = rows.join(F.broadcast(est), "month").crossJoin(F.broadcast(total))

    def counts(m: str):
        return (F.count(F.lit(1)).alias("orders"), F.sum("value").alias("revenue"),
                F.count_if(F.col("value") < F.col(m)).alias("_below"), F.count_if(F.col("value") <= F.col(m)).alias("_upto"))

    both = seen.groupBy("month").agg(*counts("_m")).unionByName(seen.groupBy(F.lit(ALL).alias("month")).agg(*counts("_all")))
    slack = SIGMAS * kll_error() * F.col("orders") + 1
    ok = (F.col("_below") <= F.col("orders") / 2 + slack) & (F.col("_upto") >= F.col("orders") / 2 - slack)
    return both.select("month", "orders", rnd("revenue", 2).alias("revenue"), ok.alias("within_error"))
