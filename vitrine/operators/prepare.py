"""Preparation operators (PRP1-PRP14): derived columns and per-order rollups.

Per-order rollups run *before* any join (map-side partial aggregation, one
shuffle on ``order_id``), so a fan-out join never multiplies detail rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import (
    DEFAULT_EXCLUDED,
    active_status,
    category_label,
    delay_days_calendar,
    delay_days_floor,
    month_label,
)
from vitrine.sources.tables import RetailTables


def orders_enriched(t: RetailTables) -> DataFrame:
    """PRP1 + PRP3: orders with ``delivery_delay_days`` (calendar days, null
    unless delivered) and ``order_month`` ('yyyy-MM')."""
    return t.orders.select(
        "*",
        delay_days_calendar().alias("delivery_delay_days"),
        month_label().alias("order_month"),
    )


def add_delay_floor(df: DataFrame, name: str = "delay_days") -> DataFrame:
    """PRP2: floor((delivered - estimated) / 1 day), the timedelta ``.days``."""
    return df.withColumn(name, delay_days_floor())


def valid_orders(orders: DataFrame, excluded=DEFAULT_EXCLUDED, keep_null: bool = False) -> DataFrame:
    """PRP10: drop excluded statuses (SQL NOT IN drops null status too)."""
    return orders.where(active_status(excluded=excluded, keep_null=keep_null))


def review_stats(reviews: DataFrame) -> DataFrame:
    """Reviews rolled up per order, enough to replay a raw review fan-out join
    exactly without materialising it: ``n_rev`` rows would have been produced
    per detail row (at least 1 under a left join), ``n_scored`` of them carry a
    score, ``sum_score`` is their total and ``n_low`` have score < 3."""
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_rev"),
        F.count("review_score").alias("n_scored"),
        F.sum("review_score").alias("sum_score"),
        F.count_if(F.col("review_score") < 3).alias("n_low"),
        F.avg("review_score").alias("avg_score"),
    )


def fanout(n_rev: str = "n_rev"):
    """Multiplicity of a detail row after ``LEFT JOIN reviews``: max(n, 1)."""
    return F.greatest(F.coalesce(F.col(n_rev), F.lit(0)), F.lit(1))


def latest_review_per_order(reviews: DataFrame) -> DataFrame:
    """PRP6/WN8: keep the last review by answer time (review id breaks ties)."""
    return reviews.groupBy("order_id").agg(
        F.max_by("review_score", F.struct("review_answer_timestamp", "review_id")).alias("review_score"))


def items_per_order(items: DataFrame) -> DataFrame:
    """PRP7: price and freight totals, item count, first product (lowest item id)."""
    return items.groupBy("order_id").agg(
        F.sum("price").alias("price"),
        F.sum("freight_value").alias("freight_value"),
        F.count("order_item_id").alias("item_count"),
        F.min_by("product_id", "order_item_id").alias("product_id"),
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    """PRP8: payment total, first payment type, any voucher used."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.min_by("payment_type", "payment_sequential").alias("payment_type"),
        F.bool_or(F.col("payment_type") == "voucher").alias("voucher_used"),
    )


def payments_per_order_mode(payments: DataFrame) -> DataFrame:
    """PRP9: payment total, max installments, modal type (lowest on a tie)."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.mode("payment_type", deterministic=True).alias("payment_type"),
    )


def delivered_paid_orders(df: DataFrame) -> DataFrame:
    """PRP11: status delivered and a positive payment."""
    return df.where((F.col("order_status") == "delivered") & (F.col("payment_value") > 0))


def fill_unknown(df: DataFrame, column: str, value: str = "Unknown") -> DataFrame:
    """PRP12: null label -> 'Unknown'."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def median_impute(df: DataFrame, column: str, tiebreak: list[str] | None = None) -> DataFrame:
    """PRP13: null -> exact column median (linear interpolation), found by a
    global rank (no single task holds the column) and broadcast as 1 row."""
    from vitrine.plans.ranking import grouped_quantiles

    med = grouped_quantiles(df, column, [0.5], [], tiebreak or []).select(F.col("q").alias("_median"))
    return (df.crossJoin(F.broadcast(med))
            .withColumn(column, F.coalesce(F.col(column), F.col("_median")))
            .drop("_median"))


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """PRP14: rows with any null feature removed."""
    return df.dropna(subset=subset)


def dedup_order_items(df: DataFrame) -> DataFrame:
    """PRP5: one row per (order_id, order_item_id) from a fanned-out frame.

    Keeps the row with the lowest payment sequential and review id, so the
    survivor is deterministic (pandas keeps the first row it happens to meet).
    """
    return (df.groupBy("order_id", "order_item_id")
            .agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("order_id", "order_item_id")]),
                          F.struct(F.col("payment_sequential"), F.col("review_id"))).alias("_r"))
            .select("order_id", "order_item_id", "_r.*"))


def items_with_category(t: RetailTables) -> DataFrame:
    """Items joined to product category (translated where possible)."""
    prod = (t.products.join(t.translation, "product_category_name", "left")
            .select("product_id", "product_category_name",
                    category_label().alias("category")))
    return t.items.join(prod, "product_id", "inner")


def category_lines(t: RetailTables) -> DataFrame:
    """Items rolled up to one row per (order, category): ``n`` lines, price and
    freight totals. The order joins then meet an order a few times at most,
    however many lines it has (map-side partial sums absorb a hot order)."""
    return _line_totals(items_with_category(t), "order_id", "category")


def order_lines(t: RetailTables) -> DataFrame:
    """Items rolled up to one row per order, with the columns of
    ``category_lines`` but the category."""
    return _line_totals(t.items, "order_id")


def _line_totals(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"),
                                    F.sum("freight_value").alias("freight_value"))


def denormalise_orders(t: RetailTables, mode: str = "rollup") -> DataFrame:
    """PRP4: orders ⟕ customers ⟕ items ⟕ payments ⟕ products ⟕ reviews ⟕
    sellers.

    ``mode='rollup'`` (default) joins payments and reviews as per-order
    rollups: one row per order item, nothing multiplied. ``mode='raw'`` is
    the notebook's frame, where an order repeats items x payments x reviews
    times; statistics over that frame are better taken from
    ``explore.order_weights``, which counts the repeats without producing them.
    """
    if mode == "raw":
        return (t.orders
                .join(t.customers, "customer_id", "left")
                .join(t.items, "order_id", "left")
                .join(t.payments, "order_id", "left")
                .join(t.products, "product_id", "left")
                .join(t.reviews, "order_id", "left")
                .join(t.sellers, "seller_id", "left"))
    pay = t.payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("payment_value").alias("payment_value"),
        F.min_by("payment_type", "payment_sequential").alias("payment_type"))
    rev = review_stats(t.reviews).select("order_id", "n_rev", "avg_score").join(
        latest_review_per_order(t.reviews), "order_id")
    return (t.orders
            .join(t.customers, "customer_id", "left")
            .join(t.items, "order_id", "left")
            .join(pay, "order_id", "left")
            .join(t.products, "product_id", "left")
            .join(rev, "order_id", "left")
            .join(t.sellers, "seller_id", "left"))


# ------------------------------------------------------------ registered
def _q_denormalised(t: RetailTables) -> DataFrame:
    """PRP4 as a query: one row per order item with per-order rollups."""
    return denormalise_orders(t).select(
        "order_id", "order_item_id", "customer_state", "product_category_name", "seller_state",
        F.col("price").cast("double").alias("price"), F.col("payment_value").cast("double").alias("payment_value"),
        "n_payments", "payment_type", "n_rev", "review_score")


def _q_dedup(t: RetailTables) -> DataFrame:
    """PRP5 as a query: one row per (order, item) of items x payments x
    reviews, where an item repeats for every payment and review of its order;
    orders without items once."""
    wide = (t.orders.select("order_id")
            .join(t.items.select("order_id", "order_item_id", "price", "freight_value"), "order_id", "left")
            .join(t.payments.select("order_id", "payment_sequential", "payment_type"), "order_id", "left")
            .join(t.reviews.select("order_id", "review_id", "review_score"), "order_id", "left"))
    return dedup_order_items(wide).select("order_id", "order_item_id",
                                          F.col("price").cast("double").alias("price"),
                                          F.col("freight_value").cast("double").alias("freight_value"),
                                          "payment_type", "review_score")


def _q_latest_review(t: RetailTables) -> DataFrame:
    return latest_review_per_order(t.reviews)


def _q_items(t: RetailTables) -> DataFrame:
    return items_per_order(t.items).select(
        "order_id", F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"), "item_count", "product_id")


def _q_payments(t: RetailTables) -> DataFrame:
    return payments_per_order(t.payments).select(
        "order_id", F.col("payment_value").cast("double").alias("payment_value"), "payment_type", "voucher_used")


def _q_payments_mode(t: RetailTables) -> DataFrame:
    return payments_per_order_mode(t.payments).select(
        "order_id", F.col("payment_value").cast("double").alias("payment_value"), "payment_installments",
        "payment_type")


def _q_enriched(t: RetailTables) -> DataFrame:
    """PRP1-PRP3 + PRP10: valid orders with both delay definitions and month."""
    o = add_delay_floor(valid_orders(orders_enriched(t)), "delay_days_floor")
    return o.select("order_id", "order_status", "delivery_delay_days", "delay_days_floor", "order_month")


def _q_sql_preview(t: RetailTables) -> DataFrame:
    """SRC4-SRC6: the tables as temp views, a SQL string run by ``spark.sql``,
    a deterministic 10-row preview of the derived columns."""
    spark = t.orders.sparkSession
    t.register_views()
    return spark.sql("""
        SELECT order_id, date_format(order_purchase_timestamp, 'yyyy-MM') AS order_month,
               datediff(to_date(order_delivered_customer_date), to_date(order_estimated_delivery_date))
                 AS delivery_delay_days
        FROM r_orders ORDER BY order_id LIMIT 10""")


QUERIES = {
    "denormalised_orders": _q_denormalised,
    "dedup_order_items": _q_dedup,
    "latest_review_per_order": _q_latest_review,
    "items_per_order": _q_items,
    "payments_per_order": _q_payments,
    "payments_per_order_mode": _q_payments_mode,
    "orders_enriched": _q_enriched,
    "sql_preview": _q_sql_preview,
}
