"""Exploration operators (EX1-EX12).

The exploratory notebook works on one wide frame: orders ⟕ customers ⟕ items ⟕
payments ⟕ products ⟕ reviews ⟕ sellers, where an order appears
``items x payments x reviews`` times. Statistics taken over that frame are
reproduced here from per-order multiplicities (``order_weights``), so the
fan-out is counted, never materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import delay_days_floor, rnd
from vitrine.sources.tables import RetailTables

QUERIES = ("total_revenue", "daily_revenue", "peak_revenue_day", "peak_day_items", "top_categories",
           "review_score_histogram", "late_delivery_stats", "review_by_delay",
           "review_by_delay_bucket", "monthly_revenue", "customers_by_state",
           "orders_per_customer", "repeat_rate")


def _count_per_order(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("order_id").agg(F.count(F.lit(1)).alias(name))


def order_weights(t: RetailTables, with_reviews: bool = True) -> DataFrame:
    """One row per order: ``w_ip`` = rows the order contributes to the wide
    frame before reviews join, ``w`` = after (left joins keep at least 1)."""
    one = F.lit(1)
    o = (t.orders.select("order_id", "customer_id", "order_purchase_timestamp",
                         "order_delivered_customer_date", "order_estimated_delivery_date")
         .join(_count_per_order(t.items, "n_i"), "order_id", "left")
         .join(_count_per_order(t.payments, "n_p"), "order_id", "left")
         .withColumn("w_ip", F.greatest(F.coalesce("n_i", F.lit(0)), one)
                     * F.greatest(F.coalesce("n_p", F.lit(0)), one)))
    if with_reviews:
        rv = t.reviews.groupBy("order_id").agg(
            F.count(one).alias("n_r"), F.count("review_score").alias("n_scored"),
            F.sum("review_score").alias("sum_score"))
        o = (o.join(rv, "order_id", "left")
             .withColumn("w", F.col("w_ip") * F.greatest(F.coalesce("n_r", F.lit(0)), one)))
    return o


def _revenue_rows(t: RetailTables) -> DataFrame:
    """Deduplicated item rows (one per order item; item-less orders once)."""
    return (t.orders.select("order_id", "order_purchase_timestamp")
            .join(t.items.select("order_id", "product_id",
                                 (F.col("price") + F.col("freight_value")).alias("revenue")),
                  "order_id", "left"))


def total_revenue(t: RetailTables) -> DataFrame:
    """EX1: Σ(price + freight) over deduplicated item rows."""
    return _revenue_rows(t).agg(rnd(F.sum("revenue"), 2).alias("total_revenue"))


def _revenue_by(t: RetailTables, key, name: str) -> DataFrame:
    return (_revenue_rows(t).groupBy(key.alias(name))
            .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("_rev"), F.count(F.lit(1)).alias("n_rows")))


def daily_revenue(t: RetailTables) -> DataFrame:
    """EX2: revenue per purchase date (days with only item-less orders: 0)."""
    d = _revenue_by(t, F.date_format("order_purchase_timestamp", "yyyy-MM-dd"), "order_date")
    return d.select("order_date", rnd("_rev", 2).alias("revenue"))


def peak_revenue_day(t: RetailTables) -> DataFrame:
    """EX3: the best day (earliest on a tie), its revenue and its item rows."""
    d = _revenue_by(t, F.date_format("order_purchase_timestamp", "yyyy-MM-dd"), "order_date")
    return (d.orderBy(F.desc("_rev"), "order_date").limit(1)
            .select("order_date", rnd("_rev", 2).alias("revenue"), "n_rows"))


def peak_day_items(t: RetailTables) -> DataFrame:
    """EX3: the item rows of the best day (earliest on a tie)."""
    day = F.date_format("order_purchase_timestamp", "yyyy-MM-dd")
    best = peak_revenue_day(t).select("order_date")
    rows = (t.orders.select("order_id", "order_status", day.alias("order_date"))
            .join(F.broadcast(best), "order_date", "left_semi")  # one day
            .join(t.items.select("order_id", "order_item_id", "product_id", "price", "freight_value"), "order_id", "left"))
    return rows.select("order_date", "order_id", "order_status", "order_item_id", "product_id",
                       F.col("price").cast("double").alias("price"), F.col("freight_value").cast("double").alias("freight_value"))


def top_categories(t: RetailTables, top: int = 10) -> DataFrame:
    """EX4: revenue per native category name, null -> 'Unknown', top ``top``."""
    rows = _revenue_rows(t).join(t.products.select("product_id", "product_category_name"),
                                 "product_id", "left")
    agg = (rows.groupBy(F.coalesce("product_category_name", F.lit("Unknown")).alias("top_category"))
           .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("_rev")))
    return (agg.orderBy(F.desc("_rev"), "top_category").limit(top)
            .select("top_category", rnd("_rev", 2).alias("revenue")))


def review_score_histogram(t: RetailTables) -> DataFrame:
    """EX5: review-score counts over the wide frame (data behind the chart)."""
    w = order_weights(t, with_reviews=False).select("order_id", "w_ip")
    return (t.reviews.where(F.col("review_score").isNotNull()).join(w, "order_id")
            .groupBy("review_score").agg(F.sum("w_ip").alias("n_rows")))


def _delays(t: RetailTables) -> DataFrame:
    return order_weights(t).withColumn("delay", delay_days_floor())


def late_delivery_stats(t: RetailTables) -> DataFrame:
    """EX6: % of delivered rows delivered late, mean delay (over the wide
    frame, as the notebook counts it)."""
    d, w = F.col("delay"), F.col("w")
    return _delays(t).agg(
        rnd(F.sum(F.when(d > 0, w).otherwise(0)) * 100.0
            / F.sum(F.when(F.col("order_delivered_customer_date").isNotNull(), w)), 2)
        .alias("pct_delayed"),
        rnd(F.sum(d * w) / F.sum(F.when(d.isNotNull(), w)), 2).alias("avg_delay_days"))


def review_by_delay(t: RetailTables) -> DataFrame:
    """EX7: mean review score per delay day."""
    w = F.col("w_ip")
    return (_delays(t).where(F.col("delay").isNotNull())
            .groupBy(F.col("delay").alias("delivery_delay"))
            .agg(rnd(F.sum(F.col("sum_score") * w) / F.sum(F.col("n_scored") * w), 4)
                 .alias("avg_review_score")))


# Fixed bucket edges and labels of the delay chart (right-closed intervals).
DELAY_BUCKETS = [(-100, -10, "Very Early"), (-10, 0, "Early"), (0, 5, "On Time"),
                 (5, 10, "Slight Delay"), (10, 20, "Delay"), (20, 100, "Severe Delay")]


def delay_bucket(col) -> F.Column:
    """SF16: right-closed fixed-edge binning; outside (-100, 100] -> null."""
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(DELAY_BUCKETS):
        expr = F.when((col > lo) & (col <= hi), F.lit(label)).otherwise(expr)
    return expr


def review_by_delay_bucket(t: RetailTables) -> DataFrame:
    """EX8: mean review score per delay bucket; all six buckets reported."""
    w = F.col("w_ip")
    agg = (_delays(t).withColumn("delay_bucket", delay_bucket(F.col("delay")))
           .where(F.col("delay_bucket").isNotNull())
           .groupBy("delay_bucket")
           .agg((F.sum(F.col("sum_score") * w) / F.sum(F.col("n_scored") * w)).alias("_avg")))
    spark = t.orders.sparkSession
    labels = spark.createDataFrame([(i, b[2]) for i, b in enumerate(DELAY_BUCKETS)],
                                   "bucket_order int, delay_bucket string")
    return (F.broadcast(labels).join(agg, "delay_bucket", "left")
            .select("bucket_order", "delay_bucket", rnd("_avg", 4).alias("avg_review_score")))


def monthly_revenue(t: RetailTables) -> DataFrame:
    """EX9: revenue per purchase month."""
    m = _revenue_by(t, F.date_format("order_purchase_timestamp", "yyyy-MM"), "month")
    return m.select("month", rnd("_rev", 2).alias("revenue"))


def customers_by_state(t: RetailTables) -> DataFrame:
    """EX10: wide-frame rows per customer state (value_counts), nulls dropped."""
    w = order_weights(t).select("customer_id", "w")
    return (w.join(t.customers, "customer_id", "left").where(F.col("customer_state").isNotNull())
            .groupBy("customer_state").agg(F.sum("w").alias("n_rows")))


def _orders_per_customer(t: RetailTables) -> DataFrame:
    return (t.orders.select("order_id", "customer_id")
            .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
            .where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n_orders")))


def orders_per_customer(t: RetailTables) -> DataFrame:
    """EX11: how many customers placed 1, 2, ... distinct orders."""
    return _orders_per_customer(t).groupBy("n_orders").agg(F.count(F.lit(1)).alias("n_customers"))


def repeat_rate(t: RetailTables) -> DataFrame:
    """EX12: share of customers with more than one order."""
    c = _orders_per_customer(t).agg(F.count(F.lit(1)).alias("total_customers"),
                                    F.count_if(F.col("n_orders") > 1).alias("repeat_customers"))
    return c.select("*", rnd(F.col("repeat_customers") * 100.0 / F.col("total_customers"), 2)
                    .alias("repeat_rate_pct"))
