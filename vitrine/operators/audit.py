"""Data audit operators (AUD1-AUD6): row counts, null profiles, shapes.

Each profile is one aggregate pass per table (every column counted in the same
scan), then an ``unpivot`` to long form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.prepare import denormalise_orders
from vitrine.sources.tables import RetailTables

QUERIES = ("table_row_counts", "null_audit_orders", "null_profile", "shape_profile", "schema_profile", "dataset_summary")

# Table names as the workload reports them, in report order.
REPORT_NAMES = {
    "orders": "orders", "customers": "customers", "items": "order_items", "products": "products",
    "sellers": "sellers", "payments": "payments", "reviews": "reviews",
    "translation": "product_category_name_translation", "geolocation": "geolocation",
}


def _present(t: RetailTables):
    """(attribute, report name) of the tables this bundle has."""
    return [(a, n) for a, n in REPORT_NAMES.items() if getattr(t, a) is not None]


def table_row_counts(t: RetailTables) -> DataFrame:
    """AUD1: (table_name, row_count) for the seven core tables, UNION ALL."""
    parts = [getattr(t, attr).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for attr, name in _present(t) if attr not in ("translation", "geolocation")]
    return reduce(DataFrame.unionByName, parts)


def null_audit_orders(t: RetailTables) -> DataFrame:
    """AUD2: total orders and nulls of four critical columns, one row."""
    return t.orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("order_status").isNull()).alias("null_status"),
        F.count_if(F.col("order_purchase_timestamp").isNull()).alias("null_purchase_date"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("null_delivery_date"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_id"),
    )


def null_counts(df: DataFrame, table_name: str) -> DataFrame:
    """Null count of every column of ``df`` in one pass, long form."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (wide.unpivot([], df.columns, "column_name", "null_count")
            .select(F.lit(table_name).alias("table_name"), "column_name", "null_count"))


def null_profile(t: RetailTables) -> DataFrame:
    """AUD3: (table_name, column_name, null_count) for every table."""
    return reduce(DataFrame.unionByName,
                  [null_counts(getattr(t, attr), name) for attr, name in _present(t)])


def shape_profile(t: RetailTables) -> DataFrame:
    """AUD4: rows and columns of every table and of the notebook's wide
    frame. The wide frame's row count is Σ items x payments x reviews per
    order (``explore.order_weights``); its column count is read from the
    plan's schema; the frame itself is never produced."""
    from vitrine.operators.explore import order_weights

    parts = [getattr(t, attr).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(getattr(t, attr).columns)).alias("n_columns"))
             for attr, name in _present(t)]
    wide_cols = len(denormalise_orders(t, mode="raw").columns)
    w = (order_weights(t).join(t.customers.select("customer_id"), "customer_id", "left")
         .agg(F.sum("w").alias("n_rows"))
         .select(F.lit("main").alias("table_name"), "n_rows", F.lit(wide_cols).alias("n_columns")))
    return reduce(DataFrame.unionByName, parts + [w])


def schema_profile(t: RetailTables) -> DataFrame:
    """AUD5: every column's place and type, with its table's rows and the
    column's non-null values, in one pass per table. Places and types come
    from the schemas (bounded by the number of columns, broadcast); the SQL
    route to them is ``DESCRIBE TABLE`` after ``register_views``."""
    meta = [(name, f.name, f.dataType.simpleString(), i)
            for attr, name in _present(t) for i, f in enumerate(getattr(t, attr).schema.fields)]
    types = t.orders.sparkSession.createDataFrame(meta, "table_name string, column_name string, data_type string, position int")
    parts = []
    for attr, name in _present(t):
        df = getattr(t, attr)
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
        parts.append(wide.unpivot(["_rows"], df.columns, "column_name", "non_null")
                     .select(F.lit(name).alias("table_name"), "column_name", F.col("_rows").alias("n_rows"), "non_null"))
    return (reduce(DataFrame.unionByName, parts).join(F.broadcast(types), ["table_name", "column_name"])
            .select("table_name", "column_name", "data_type", "position", "n_rows", "non_null"))


def dataset_summary(t: RetailTables) -> DataFrame:
    """AUD6: rows, distinct customers, distinct orders, first and last order
    date of orders ⟕ payments ⟕ customers (the A/B notebook's frame).

    No join: each side is counted under its key where all tables meet
    (orders and payments by order, then their rows and customers by customer),
    so a row stands for as many rows of the frame as it has partners. Order ids
    are unique (the key of their table).
    """
    o = t.orders.select("order_id", "customer_id", F.col("order_purchase_timestamp").alias("_ts"), F.lit(1).alias("_o"), F.lit(0).alias("_p"))
    p = t.payments.select("order_id", F.lit(None).cast(t.orders.schema["customer_id"].dataType).alias("customer_id"), F.lit(None).cast("timestamp").alias("_ts"), F.lit(0).alias("_o"), F.lit(1).alias("_p"))
    per_order = o.withColumn("_ts", F.col("_ts").cast("timestamp")).unionByName(p).groupBy("order_id").agg(
        F.sum("_o").alias("_o"), F.sum("_p").alias("_p"), F.max("customer_id").alias("customer_id"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last")).where("_o > 0")
    weighed = per_order.select("customer_id", (F.col("_o") * F.greatest("_p", F.lit(1))).alias("_w"), F.lit(1).alias("_n"), "_first", "_last",
                               F.lit(None).cast(t.customers.schema["customer_unique_id"].dataType).alias("customer_unique_id"), F.lit(0).alias("_c"))
    people = t.customers.select("customer_id", F.lit(0).alias("_w"), F.lit(0).alias("_n"), F.lit(None).cast("timestamp").alias("_first"), F.lit(None).cast("timestamp").alias("_last"), "customer_unique_id", F.lit(1).alias("_c"))
    per_customer = weighed.unionByName(people).groupBy("customer_id").agg(
        F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.sum("_c").alias("_c"), F.max("customer_unique_id").alias("customer_unique_id"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last")).where("_n > 0")
    per_person = per_customer.groupBy("customer_unique_id").agg(
        F.sum(F.col("_w") * F.greatest(F.when(F.col("customer_id").isNotNull(), F.col("_c")), F.lit(1))).alias("_w"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return per_person.agg(
        F.coalesce(F.sum("_w"), F.lit(0)).alias("n_rows"), F.count("customer_unique_id").alias("unique_customers"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("unique_orders"),
        F.date_format(F.min("_first"), "yyyy-MM-dd").alias("first_order_date"), F.date_format(F.max("_last"), "yyyy-MM-dd").alias("last_order_date"))
