"""Cohort operators (CO1-CO5).

``COUNT(DISTINCT CASE WHEN month_number = k THEN customer END)`` for seven k
would make Spark expand every row seven times. Instead the plan deduplicates
(customer, month) pairs first (partial aggregation), takes each customer's
first month from those pairs, and counts pairs per (cohort, k): a customer has
at most one pair per k, so plain counts are distinct counts. The join back to
the first month is on at most one row per (customer, month), so a customer
with a third of all orders still contributes only a few dozen rows to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import DEFAULT_EXCLUDED, active_status, month_label, pct, period_diff, rnd
from vitrine.sources.tables import RetailTables

QUERIES = ("customer_cohort", "cohort_retention", "cohort_retention_pct", "cohort_revenue",
           "retention_matrix", "cohort_retention_as_written")

MAX_MONTH = 6


def _customer_orders(t: RetailTables, excluded) -> DataFrame:
    return (t.orders.where(active_status(excluded=excluded))
            .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id"))


def customer_cohort(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """CO1: (customer_unique_id, cohort_month 'yyyy-MM') = first purchase month."""
    return (_customer_orders(t, excluded)
            .groupBy("customer_unique_id")
            .agg(F.min(month_label()).alias("cohort_month")))


def _cohort_pairs(t: RetailTables, excluded) -> DataFrame:
    pairs = (_customer_orders(t, excluded)
             .select("customer_unique_id", month_label(fmt="yyyyMM").alias("order_month"))
             .distinct())
    first = pairs.groupBy("customer_unique_id").agg(F.min("order_month").alias("cohort_month"))
    return (pairs.join(first, "customer_unique_id")
            .withColumn("month_number", period_diff("order_month", "cohort_month")))


def cohort_retention(t: RetailTables, excluded=DEFAULT_EXCLUDED, max_month: int = MAX_MONTH) -> DataFrame:
    """CO2: cohort size and distinct active customers in months 1..6 after
    the first purchase, per cohort ('yyyyMM')."""
    k = F.col("month_number")
    return (_cohort_pairs(t, excluded).where(k <= max_month)
            .groupBy("cohort_month")
            .agg(F.count_if(k == 0).alias("cohort_size"),
                 *[F.count_if(k == i).alias(f"month_{i}") for i in range(1, max_month + 1)]))


def cohort_retention_pct(t: RetailTables, excluded=DEFAULT_EXCLUDED, max_month: int = MAX_MONTH) -> DataFrame:
    """CO3: the same as percentages of the cohort, 1 decimal."""
    c = cohort_retention(t, excluded, max_month)
    return c.select("cohort_month", "cohort_size",
                    *[pct(f"month_{i}", "cohort_size").alias(f"pct_month_{i}")
                      for i in range(1, max_month + 1)])


def retention_matrix(t: RetailTables, excluded=DEFAULT_EXCLUDED, max_month: int = MAX_MONTH) -> DataFrame:
    """CO5: every month column divided by the cohort size (heatmap data)."""
    c = cohort_retention(t, excluded, max_month)
    return c.select("cohort_month",
                    *[rnd(F.col(f"month_{i}") / F.col("cohort_size"), 6).alias(f"rate_month_{i}")
                      for i in range(1, max_month + 1)])


def cohort_revenue(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """CO4: per cohort ('yyyy-MM'): customers with item revenue, item revenue,
    revenue per customer. Items are summed per order before the join."""
    cohorts = customer_cohort(t, excluded)
    per_order = t.items.groupBy("order_id").agg(F.sum("price").alias("price"))
    per_customer = (_customer_orders(t, excluded).select("order_id", "customer_unique_id")
                    .join(per_order, "order_id")
                    .groupBy("customer_unique_id").agg(F.sum("price").alias("price")))
    agg = (per_customer.join(cohorts, "customer_unique_id")
           .groupBy("cohort_month")
           .agg(F.count(F.lit(1)).alias("cohort_size"), F.sum("price").alias("_rev")))
    return agg.select("cohort_month", "cohort_size", rnd("_rev", 2).alias("total_revenue"),
                      rnd(F.col("_rev") / F.col("cohort_size"), 2).alias("revenue_per_customer"))


def cohort_retention_as_written(t: RetailTables) -> DataFrame:
    """CO2 with the original status spelling ('cancelled'), as the golden
    cohort file was produced."""
    return cohort_retention(t, excluded=("cancelled", "unavailable"))
